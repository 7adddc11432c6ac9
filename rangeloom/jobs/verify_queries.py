"""Written archives read back and checked, reader checks, presets, reports: each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, digests, intervals, measures, summary, validation, walks
from ..sources import archive
from ..sources import tables as T
from ..sources.scratch import scratch_dir, shared_folder
from . import sql as S
from .archive_queries import _tiles, _visits
from .index_queries import _COUNTERS, _LOCI, _SUMMARY, _loci, _pyramid
from .walk_queries import event_walks

TILE = "manifest_id long, bucket_id long, tile_index long, core_start long, core_end long, payload string, digest string, size long"


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tile_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with their content as text (start:handle:sequence of each visit, in order), its digest and size. A tile has at most as many visits as bases."""
    v = _visits(spark, sf).join(T.nodes(spark, sf), "node_id")
    span = T.WINDOW_BASES
    filed = v.select("contig", F.concat_ws(":", F.col("start").cast("string"), F.col("handle").cast("string"), "seq").alias("visit"), F.col("start").alias("at"), F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))).alias("_w"))
    held = _tiles(spark, sf).withColumn("_w", F.floor(F.col("core_start") / span)).join(filed, ["contig", "_w"])
    held = held.groupBy("manifest_id", "bucket_id", "tile_index", "core_start", "core_end").agg(F.array_sort(F.collect_list(F.struct("at", "visit"))).alias("v"))
    held = held.withColumn("payload", F.array_join(F.transform("v", lambda x: x["visit"]), ";")).drop("v")
    return held.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """The archive's tiles, written by manifest and bucket once a session, and read back."""

    def write(path: str) -> None:
        archive.publish({"tiles": (tile_payloads(spark, sf), ["manifest_id", "bucket_id"])}, path)

    path = shared_folder(spark, "archive", [T.read(spark, sf, "part")], write)
    return archive.load(spark, path, "tiles", TILE)


def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every tile after writing and reading, by manifest: tiles, buckets, bytes, and a digest of the tiles' digests in order."""
    t = _written(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("bucket_id", "tile_index", "digest")))
    by_bucket = t.groupBy("manifest_id", "bucket_id").agg(F.count(F.lit(1)).alias("tiles"), F.sum("size").alias("bytes"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ","), 256).alias("digest"))
    return by_bucket.select("manifest_id", "bucket_id", "tiles", "bytes", "digest")


def digest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty payloads a manifest of the archive as it was written: none."""
    t = _written(spark, sf)
    bad = validation.digest_faults(t).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("faults"))
    return t.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("tiles")).join(bad, "manifest_id", "left").select("manifest_id", "tiles", F.coalesce("faults", F.lit(0)).alias("faults"))


def corrupt_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Faults planted in an archive by tile number, and what the checks say of each tile."""
    t, i = _written(spark, sf), F.col("tile_index")
    broken = (
        t.where(i % 13 != 5)
        .withColumn("payload", F.when(i % 13 == 1, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
        .withColumn("size", F.when(i % 13 == 2, F.col("size") + 1).otherwise(F.col("size")))
        .withColumn("core_end", F.when(i % 13 == 3, F.col("core_end") + 1).otherwise(F.col("core_end")))
    )
    broken = broken.unionByName(broken.where(i % 13 == 4)).unionByName(broken.where(i % 13 == 6).withColumn("tile_index", i + 1_000_000))
    content = validation.digest_faults(broken).select("manifest_id", "tile_index", "fault")
    return content.unionByName(validation.directory_faults(broken, _tiles(spark, sf)))


def archive_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Reference visits rebuilt from the written tiles against the source walk: visits and bases a contig, missing and extra visits."""
    part = F.explode(F.transform(F.split("payload", ";"), lambda x: F.split(x, ":")))
    held = _written(spark, sf).join(T.manifests(spark, sf).select("manifest_id", "contig"), "manifest_id").select("contig", part.alias("p"))
    rebuilt = held.select("contig", F.col("p")[0].cast("long").alias("start"), F.col("p")[1].cast("long").alias("handle"), F.col("p")[2].alias("seq")).distinct()
    source = _visits(spark, sf).join(T.nodes(spark, sf), "node_id").select("contig", "start", "handle", "seq")
    both = audit.pairing(source, rebuilt, ["contig", "start", "handle"], ["seq"])
    return both.groupBy("contig").agg(F.count_if(F.col("status") == "same").alias("visits"), F.sum(F.length("b_seq")).alias("bases"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "extra").alias("extra"), F.count_if(F.col("status") == "differs").alias("differs"))


def summary_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in a series of tiles as bins, from which every seventh bin was taken."""
    bins = _tiles(spark, sf).where(F.col("tile_index") % 7 != 3).select("manifest_id", F.lit(0).alias("level"), F.lit(T.WINDOW_BASES).cast("long").alias("bin_span"), (F.floor(F.col("core_start") / T.WINDOW_BASES) * T.WINDOW_BASES).alias("bin_start"))
    return summary.bin_contiguity_violations(bins).select("manifest_id", "bin_start")


def summary_files(spark: SparkSession, sf: str) -> DataFrame:
    """The pyramid written by level and read back: bins and counters of each level."""
    path = _path(spark, "summary")
    rows = _pyramid(spark, sf)
    archive.publish({"bins": (rows, ["level"])}, path)
    return archive.load(spark, path, "bins", rows.schema).groupBy("level").agg(F.count(F.lit(1)).alias("bins"), *[F.sum(c).alias(c) for c in summary.COUNTERS])


def membership_files(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, memberships and paths of the event tiles, written by week and read back, joined again."""
    path = _path(spark, "members")
    m = walks.memberships(event_walks(spark, sf)).withColumnRenamed("reversed", "is_reversed").withColumn("walk", F.array_join(F.transform("walk", lambda h: h.cast("string")), ",")).withColumn("week", F.floor(F.col("tile_id") / 28))
    keys = ["tile_id", "walk"]
    groups = m.groupBy("week", *keys).agg(F.sum("multiplicity").alias("weight")).withColumn("group_id", F.xxhash64(*keys))
    members = m.select("week", F.xxhash64(*keys).alias("group_id"), "tile_id", "path_id", "is_reversed", "multiplicity")
    archive.publish({"groups": (groups, ["week"]), "memberships": (members, ["week"]), "paths": (m.select("path_id").distinct().withColumn("part", F.pmod("path_id", F.lit(8))), ["part"])}, path)
    g, b, p = (archive.load(spark, path, n, df.schema) for n, df in (("groups", groups), ("memberships", members), ("paths", m.select("path_id"))))
    held = g.join(b.drop("tile_id"), ["week", "group_id"]).join(p.select("path_id").distinct(), "path_id")
    return held.groupBy("week").agg(F.count(F.lit(1)).alias("memberships"), F.sum("multiplicity").alias("occurrences"), F.countDistinct("group_id").alias("groups"), F.countDistinct("path_id").alias("paths"))


def locus_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Named loci in pages by key: each key's records, and in how many pages it stands (one)."""
    pages = archive.ordered_pages(_loci(spark, sf), "normalized_key", "contig", "start", pages=16)
    return pages.groupBy("normalized_key").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("page").alias("pages"))


def workload_file(spark: SparkSession, sf: str) -> DataFrame:
    """A workload written as JSON lines, a line for each order, and read again: problems by kind."""
    o, k = T.read(spark, sf, "orders"), F.col("o_orderkey")
    lines = o.select(
        F.when(k % 17 == 0, 2).otherwise(1).alias("schemaVersion"), k.alias("id"), F.lit("REF").alias("sample"), "o_orderpriority", (k % 1000).alias("start"), (k % 1000 + k % 4).alias("end"),
        F.when(k % 5 != 0, F.md5(k.cast("string"))).alias("expectedHash"), F.when((k % 5 == 0) | (k % 7 == 0), F.lit("reference-not-found")).alias("expectedError"),
    ).withColumnRenamed("o_orderpriority", "contig")
    path = _path(spark, "workload")
    archive.write_json(lines, path)
    return archive.read_workload(spark, path).groupBy("contig", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("queries"), F.count("expectedHash").alias("hashes"))


def catalog_file(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of paths written as JSON lines and read again: paths a sample, and ids that do not follow their predecessor's, as order keys leave gaps."""
    path = _path(spark, "catalog")
    archive.write_json(T.paths(spark, sf), path)
    c = archive.read_catalog(spark, path)
    follows = c.select((F.col("path_id") + 1).alias("path_id"), F.lit(True).alias("_follows"))
    held = c.join(follows, "path_id", "left")
    return held.groupBy("sample").agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("_follows").isNull()).alias("starts"), F.max("canonical_name").alias("last_name"))


def prepared_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared memberships of the event tiles, spoilt by tile number, written as JSON lines, read again and checked.

    Of seven tiles one has wrong weights, one ids beyond the catalog, one no walks, one is missing, one ends late and one
    has wrong numbers of paths. The catalog lacks every fiftieth user and declares a path too many.
    """
    m = walks.memberships(event_walks(spark, sf))
    kind, span = F.pmod("tile_id", F.lit(7)), T.EVENT_TILE_MS
    none = F.array().cast("array<long>")

    def told(rows: DataFrame) -> DataFrame:
        placed = rows.where(kind != 4).withColumn("start", F.col("tile_id") * span).withColumn("end", F.col("start") + span + F.when(kind == 5, 1).otherwise(0))
        return placed.withColumn("walk", F.when((kind == 3) & (F.col("walk")[0] % 4 == 2), none).otherwise(F.col("walk")))

    groups = walks.membership_groups(m).withColumn("weight", F.col("occurrence_weight") + F.when(kind == 1, 1).otherwise(0)).withColumn("unique_paths", F.col("unique_path_count") + F.when(kind == 6, 1).otherwise(0))
    members = m.withColumn("path_id", F.col("path_id") + F.when(kind == 2, 1 << 40).otherwise(0))
    users = T.read(spark, sf, "events").where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("path_id")).distinct().where(F.col("path_id") % 50 != 49)
    path = _path(spark, "prepared")
    lines = archive.prepared_lines(
        users.withColumn("canonical_name", F.concat(F.lit("user#"), F.col("path_id").cast("string"))),
        told(groups).where(F.size("walk") > 0).select("start", "end", "walk", "weight", "unique_paths"),
        told(members).where(F.size("walk") > 0).select("start", "end", "walk", "path_id", "multiplicity", "reversed"),
        spare=1,
    )
    bare = told(groups).where(F.size("walk") == 0).select(F.lit("group").alias("type"), "start", "end", "walk", "weight", "unique_paths")
    archive.write_json(lines.unionByName(bare, allowMissingColumns=True), path)
    tiles = T.event_visits(spark, sf).select((F.col("tile_id") * span).alias("start"), ((F.col("tile_id") + 1) * span).alias("end")).distinct()
    return archive.prepared_problems(archive.read_prepared(spark, path), tiles)


def query_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a query made of each order."""
    o, k = T.read(spark, sf, "orders"), F.col("o_orderkey")
    start = k % 97 - F.when(k % 13 == 0, 50).otherwise(0)
    problem = validation.query_problem(F.when(k % 11 == 0, "").otherwise(F.lit("REF")), F.col("o_orderpriority"), start, k % 97 + k % 5, F.when(k % 3 == 0, k % 140))
    return o.select("o_orderkey", F.coalesce(problem, F.lit("none")).alias("problem"))


def archive_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Extensions of an archive for each supplier, a type for each of its lines' numbers."""
    held = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("archive"), F.col("l_linenumber").cast("int").alias("type"), "l_partkey").where("type + l_partkey % 9 > 8")
    return validation.capabilities(held, ["archive"], "type", {"named_loci": 5, "multiscale_summaries": 6, "path_membership": 7})


def provenance_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance of an archive for each part: codec and sense by name, the digest in hex, optional fields left out."""
    p = T.read(spark, sf, "part")
    codec = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(6), F.lit(9)), (F.col("p_size") % 5 + 1).cast("int"))
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("datasetTitle="), "p_name"))
    assembly = F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("referenceAssembly="), "p_brand"))
    digest = F.concat(F.lit("sourceGbzSha256="), F.lower(F.hex(F.unhex(F.sha2("p_name", 256)))))
    return p.select("p_partkey", validation.codec_label(codec).alias("codec"), validation.sense_label(F.col("p_size") % 4).alias("sense"), F.concat_ws(";", digest, title, assembly).alias("provenance"))


def identity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the digest that the membership files name as their source is the archive's, by contig; both are written and read.

    The membership of the contigs that end in 3 was built from a walk that lacks its last visit.
    """
    ref = T.reference_walk(spark, sf)

    def write(path: str) -> None:
        def told(walk: DataFrame) -> DataFrame:
            return digests.tree_digest(walk, ["contig"], "ord", F.col("handle").cast("string")).select("contig", "digest")

        last = ref.groupBy("contig").agg(F.max("ord").alias("_last"))
        other = ref.join(last, "contig").where(~(F.col("contig").endswith("3") & (F.col("ord") == F.col("_last")))).drop("_last")
        told(ref).write.parquet(f"{path}/archive")
        told(other).write.parquet(f"{path}/members")

    path = shared_folder(spark, "identities", [T.read(spark, sf, "part")], write)
    own, named = (spark.read.schema("contig string, digest string").parquet(f"{path}/{n}") for n in ("archive", "members"))
    both = audit.pairing(own, named, ["contig"], ["digest"])
    return both.select("contig", (F.col("status") == "same").alias("same_source"))


def tile_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Graph entries and membership entries of each event tile, joined by tile; every fifth tile has no memberships."""
    v = T.event_visits(spark, sf)
    graph = v.groupBy("tile_id").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("handle").alias("records"))
    members = walks.membership_groups(walks.memberships(event_walks(spark, sf))).where(F.col("tile_id") % 5 != 0)
    entries = members.groupBy("tile_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("occurrence_weight").alias("occurrences"))
    held = graph.join(entries, "tile_id", "full_outer")
    return held.select("tile_id", "visits", "records", "groups", "occurrences", F.when(F.col("groups").isNull(), "no memberships").when(F.col("visits").isNull(), "no graph").otherwise("both").alias("status"))


def preset_match(spark: SparkSession, sf: str) -> DataFrame:
    """Presets of the event tiles' walks, some spoilt by tile number, and what does not match."""
    m = walks.memberships(event_walks(spark, sf)).withColumnRenamed("reversed", "is_reversed")
    m = m.withColumn("digest", F.sha2(F.array_join(F.transform("walk", lambda h: h.cast("string")), ","), 256))
    members = m.select("tile_id", "digest", "path_id", "multiplicity", "is_reversed")
    groups = members.groupBy("tile_id", "digest").agg(F.sum("multiplicity").alias("weight"))
    t = F.col("tile_id")
    expected = members.groupBy("tile_id", "digest").agg(F.sum("multiplicity").alias("weight"), F.array_sort(F.collect_list(F.struct("path_id", "multiplicity", "is_reversed"))).alias("members"))
    expected = expected.withColumn("preset_id", F.concat_ws("/", t.cast("string"), "digest")).withColumn("kind", t % 7)
    expected = (
        expected.withColumn("tile_id", F.when(F.col("kind") == 1, t + 10**9).otherwise(t))
        .withColumn("digest", F.when(F.col("kind") == 2, F.sha2("digest", 256)).otherwise(F.col("digest")))
        .withColumn("weight", F.when(F.col("kind") == 3, F.col("weight") + 1).otherwise(F.col("weight")))
        .withColumn("members", F.when(F.col("kind") == 4, F.slice("members", 2, 1 << 20)).when(F.col("kind") == 5, F.transform("members", lambda x: F.struct((x["path_id"] + 10**9).alias("path_id"), x["multiplicity"].alias("multiplicity"), x["is_reversed"].alias("is_reversed")))).otherwise(F.col("members")))
    )
    tiles = m.select("tile_id").distinct()
    return validation.preset_verdicts(expected, tiles, groups, members).select("preset_id", "verdict")


def locate_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from a visit back to the last sampled one of its walk, every sixteenth, as order statistics by node kind."""
    steps = T.event_visits(spark, sf).select(F.floor(F.col("handle") / 2).alias("node_id"), ((F.col("ord") - 1) % 16).alias("steps"))
    d = measures.distribution_nearest_rank(steps, ["node_id"], "steps").withColumnsRenamed({"max": "most", "n": "positions"}).drop("min")
    return d.join(steps.groupBy("node_id").agg(F.sum("steps").alias("total_steps")), "node_id")


def topology_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a view of each supplier's parts must be aggregated, at a width of its own."""
    line = T.read(spark, sf, "lineitem")
    seen = line.groupBy(F.col("l_suppkey").alias("view")).agg(F.countDistinct(F.when(F.col("l_quantity") > 10, F.col("l_partkey"))).alias("nodes"), F.count_if(F.col("l_returnflag") == "N").alias("edges"))
    width = 200 + F.col("view") * 37 % 1500
    return seen.select("view", width.alias("width"), "nodes", "edges", validation.aggregates_topology(width, F.col("nodes"), F.col("edges")).alias("aggregated"))


def display_refusal(spark: SparkSession, sf: str) -> DataFrame:
    """What a display of the parts and lines of each line number would have to cut."""
    line = T.read(spark, sf, "lineitem")
    seen = line.groupBy(F.col("l_linenumber").alias("view")).agg(F.countDistinct("l_partkey").alias("groups"), F.count(F.lit(1)).alias("edges"))
    return seen.select("view", F.coalesce(validation.display_refusal(F.col("groups"), F.col("edges")), F.lit("shown")).alias("message"))


def visual_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Each region as a zoomed and panned view shows it."""
    q, k = T.region_queries(spark, sf), F.col("query_id")
    left, right = validation.visual_interval(F.col("q_start"), F.col("q_end"), 1 + (k % 4).cast("double") / 2, (k % 301 - 150).cast("double"), (k % 900).cast("double"))
    return q.select("query_id", left.alias("view_start"), right.alias("view_end"))


def size_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the orders' totals as text: with separators, with a unit, and as hex of eight digits."""
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 97)
    return T.read(spark, sf, "orders").select("o_orderkey", F.format_number(n, 0).alias("separated"), validation.size_label(n).alias("labelled"), F.lower(F.lpad(F.hex(n), 8, "0")).alias("hex"))


def seeded_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Three seeded random numbers for each supplier, the last bounded."""
    one = validation.xorshift64(F.col("s_suppkey") * 2654435761 + 1)
    two = validation.xorshift64(one)
    return T.read(spark, sf, "supplier").select("s_suppkey", F.hex(one).alias("first"), F.hex(two).alias("second"), validation.unsigned_mod(validation.xorshift64(two), 1000).alias("bounded"))


def grouped_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Order statistics by configuration and class, and by configuration alone under the class 'all'."""
    m = T.measurements(spark, sf)
    both = m.withColumn("class", F.explode(F.array("class", F.lit("all"))))
    return measures.distribution_ceil(both, ["config", "class"], "latency").withColumnsRenamed({"max": "longest", "min": "shortest"})


def dedup_choice(spark: SparkSession, sf: str) -> DataFrame:
    """For each class the configuration to improve (least p95, then bytes, then name, among those that repeat bytes), and what improving saves."""
    o = T.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("config"), F.col("o_orderpriority").alias("class"), F.floor("o_totalprice").cast("long").alias("bytes"), F.pmod("o_custkey", F.lit(50)).alias("block"))
    p95 = measures.distribution_ceil(o, ["class", "config"], "bytes", (95,)).select("class", "config", "p95")
    unique = o.groupBy("class", "config", "block").agg(F.max("bytes").alias("kept"), F.sum("bytes").alias("total"))
    runs = unique.groupBy("class", "config").agg(F.sum("total").alias("bytes_before"), F.sum("kept").alias("bytes_after")).join(p95, ["class", "config"]).where(F.col("bytes_before") > F.col("bytes_after"))
    best = runs.groupBy("class").agg(F.min(F.struct("p95", "bytes_before", "config", "bytes_after")).alias("b")).select("class", "b.config", "b.p95", "b.bytes_before", "b.bytes_after")
    return best.withColumn("ratio", F.round(measures.ratio(F.col("bytes_after"), F.col("bytes_before")), 9))


def benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per ship supplier modulo ten: queries, passed, failed, bytes in all, once and again, and order statistics of latency."""
    line = T.read(spark, sf, "lineitem").withColumn("kind", F.col("l_suppkey") % 10)
    ms = F.col("l_quantity").cast("long")
    totals = line.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("l_returnflag") != "R").alias("passed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.sum(ms * 8).alias("response_bytes"))
    reads = line.select("kind", (F.col("l_partkey") * 64).alias("start"), (F.col("l_partkey") * 64 + ms * 8).alias("end"))
    unique = intervals.union_length(reads, ["kind"]).select("kind", F.col("covered").alias("unique_bytes"))
    latency = measures.distribution_ceil(line.select("kind", ms.alias("ms")), ["kind"], "ms").select("kind", "p50", "p90", "p95", "p99", F.col("max").alias("longest"))
    return totals.join(unique, "kind").join(latency, "kind").withColumn("duplicate_bytes", F.col("response_bytes") - F.col("unique_bytes"))


def view_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level of each reference for views of ten groups of regions, of at most twelve bins each."""
    picked = intervals.select_manifests(T.region_queries(spark, sf), T.manifests(spark, sf)).withColumn("view", F.col("query_id") % 10)
    bins = _pyramid(spark, sf).select("manifest_id", "level", "bin_span", "bin_start")
    spans = bins.select("manifest_id", "level", "bin_span").distinct()
    asked = picked.join(spans, "manifest_id")
    asked = asked.withColumn("bin_start", F.explode(F.sequence(F.floor(F.col("q_start") / F.col("bin_span")), F.floor((F.col("q_end") - 1) / F.col("bin_span"))))).withColumn("bin_start", F.col("bin_start") * F.col("bin_span"))
    series = asked.join(bins, ["manifest_id", "level", "bin_span", "bin_start"]).groupBy("view", "manifest_id", "level").agg(F.countDistinct("bin_start").alias("bins"))
    return summary.levels_within(series, ["view"], 12)


_PAYLOADS = f"""{S.NODES}, {S.REFERENCE}, payloads AS (
  SELECT t.manifest_id, t.bucket_id, t.tile_index, t.core_start, t.core_end, string_agg(v.s::VARCHAR || ':' || v.handle::VARCHAR || ':' || n.seq, ';' ORDER BY v.s) AS payload
  FROM tiles t JOIN visits v ON t.contig = v.contig AND v.s < t.core_end AND v.e > t.core_start JOIN nodes n ON n.node_id = v.node_id GROUP BY ALL)"""
_GROUPS = "member AS (SELECT tile_id, walk, path_id, is_reversed, count(*) AS multiplicity FROM canonical GROUP BY ALL)"


_M = "18446744073709551616::HUGEINT"


def _xorshift(source: str, x: str, out: str) -> str:
    """Common table expressions of a generator step on a HUGEINT of 64 bits; the last is named as its column."""
    return (
        f"{out}1 AS (SELECT *, xor({x}, ({x} * 8192) % {_M}) AS {out}_p FROM {source}), {out}2 AS (SELECT *, xor({out}_p, {out}_p // 128) AS {out}_q FROM {out}1), "
        f"{out}3 AS (SELECT *, xor({out}_q, ({out}_q * 131072) % {_M}) AS {out} FROM {out}2)"
    )


_PREPARED = f"""WITH {S.EVENT_GROUPS}, g AS (SELECT tile_id, tile_id % 7 AS k, tile_id * 21600000 AS s, (tile_id + 1) * 21600000 AS e, walk, tile_id % 7 = 3 AND walk[1] % 4 = 2 AS bare FROM (SELECT DISTINCT tile_id, walk FROM canonical)),
users AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 50 <> 49),
held AS (SELECT c.tile_id, path_id FROM (SELECT DISTINCT tile_id, walk, path_id, is_reversed FROM canonical) c JOIN g ON g.tile_id = c.tile_id AND g.walk = c.walk WHERE NOT bare AND k <> 4 AND (k = 2 OR path_id NOT IN (SELECT u FROM users)))
SELECT NULL::BIGINT AS "start", NULL::BIGINT AS "end", 'paths are not as many as declared' AS problem, 1 AS n
UNION ALL SELECT NULL, NULL, 'path id does not follow', count(*) FROM users WHERE u <> 0 AND u - 1 NOT IN (SELECT u FROM users) HAVING count(*) > 0
UNION ALL SELECT DISTINCT s, e + 1, 'tile is not in the graph', 1 FROM g WHERE k = 5
UNION ALL SELECT DISTINCT s, e, 'tile is missing', 1 FROM g WHERE k IN (4, 5)
UNION ALL SELECT s, e, 'empty walk', count(*) FROM g WHERE bare GROUP BY s, e
UNION ALL SELECT tile_id * 21600000, (tile_id + 1) * 21600000 + CASE WHEN tile_id % 7 = 5 THEN 1 ELSE 0 END, 'path is not in the catalog', count(*) FROM held GROUP BY tile_id
UNION ALL SELECT s, e, CASE k WHEN 1 THEN 'weight differs' ELSE 'number of paths differs' END, count(*) FROM g WHERE k IN (1, 6) GROUP BY s, e, k"""

QUERIES = {
    "prepared_membership": (prepared_membership, _PREPARED),
    "archive_round_trip": (archive_round_trip, f"WITH {_PAYLOADS} SELECT manifest_id, bucket_id, count(*) AS tiles, sum(strlen(payload))::BIGINT AS bytes, sha256(string_agg(sha256(payload), ',' ORDER BY tile_index)) AS digest FROM payloads GROUP BY ALL"),
    "digest_check": (digest_check, f"WITH {_PAYLOADS} SELECT manifest_id, count(*) AS tiles, 0::BIGINT AS faults FROM payloads GROUP BY ALL"),
    "corrupt_matrix": (corrupt_matrix, f"""WITH {_PAYLOADS} SELECT manifest_id, unnest(CASE tile_index % 13 WHEN 6 THEN [tile_index + 1000000] ELSE [tile_index] END) AS tile_index,
      (['digest', 'size', 'misplaced', 'repeated', 'missing', 'unknown'])[(tile_index % 13)::INT] AS fault FROM payloads WHERE tile_index % 13 BETWEEN 1 AND 6"""),
    "archive_rebuild": (archive_rebuild, f"WITH {S.REFERENCE_WALK} SELECT contig, count(*) AS visits, sum(seq_len)::BIGINT AS bases, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS differs FROM reference_walk GROUP BY contig"),
    "summary_contiguity": (summary_contiguity, f"WITH {S.REFERENCE} SELECT manifest_id, w AS bin_start FROM (SELECT *, lag(w) OVER (PARTITION BY manifest_id ORDER BY w) AS p FROM tiles WHERE tile_index % 7 <> 3) WHERE w - p <> 64"),
    "summary_files": (summary_files, f"WITH {_SUMMARY} SELECT level, count(*) AS bins, {_COUNTERS} FROM pyramid GROUP BY level"),
    "membership_files": (membership_files, f"WITH {S.EVENT_GROUPS}, {_GROUPS} SELECT tile_id // 28 AS week, count(*) AS memberships, sum(multiplicity)::BIGINT AS occurrences, count(DISTINCT (tile_id, walk)) AS groups, count(DISTINCT path_id) AS paths FROM member GROUP BY ALL"),
    "locus_pages": (locus_pages, f"WITH {_LOCI} SELECT normalized_key, count(*) AS records, 1 AS pages FROM loci GROUP BY normalized_key"),
    "workload_file": (workload_file, "SELECT contig, problem, count(*) AS queries, count(*) FILTER (WHERE k % 5 <> 0) AS hashes FROM (SELECT o_orderpriority AS contig, o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'version' WHEN (o_orderkey % 5 <> 0) = (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 'expectation' WHEN o_orderkey % 4 = 0 THEN 'interval' ELSE 'none' END AS problem FROM orders) GROUP BY ALL"),
    "catalog_file": (catalog_file, f"WITH {S.PATHS} SELECT sample, count(*) AS paths, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = p.path_id - 1)) AS starts, max(canonical_name) AS last_name FROM paths p GROUP BY sample"),
    "query_validation": (query_validation, "SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN 'empty name' WHEN k % 13 = 0 AND k % 97 < 50 THEN 'not a safe integer' WHEN k % 97 + k % 5 <= k % 97 - CASE WHEN k % 13 = 0 THEN 50 ELSE 0 END THEN 'empty interval' WHEN k % 3 = 0 AND k % 140 > 100 THEN 'context too wide' ELSE 'none' END AS problem FROM (SELECT o_orderkey AS k FROM orders)"),
    "archive_capabilities": (archive_capabilities, "SELECT l_suppkey AS archive, bool_or(l_linenumber = 5) AS named_loci, bool_or(l_linenumber = 6) AS multiscale_summaries, bool_or(l_linenumber = 7) AS path_membership FROM lineitem WHERE l_linenumber + l_partkey % 9 > 8 GROUP BY ALL"),
    "provenance_labels": (provenance_labels, "SELECT p_partkey, (['none', 'zstd-1', 'zstd-3', 'zstd-6', NULL])[(p_size % 5 + 1)::INT] AS codec, (['unknown', 'generic', 'reference', 'haplotype'])[(p_size % 4 + 1)::INT] AS sense, concat_ws(';', 'sourceGbzSha256=' || sha256(p_name), CASE WHEN p_size % 3 = 0 THEN 'datasetTitle=' || p_name END, CASE WHEN p_size % 4 = 1 THEN 'referenceAssembly=' || p_brand END) AS provenance FROM part"),
    "identity_check": (identity_check, "SELECT p_brand AS contig, NOT p_brand LIKE '%3' AS same_source FROM part GROUP BY p_brand"),
    "tile_memberships": (tile_memberships, f"WITH {S.EVENT_GROUPS}, g AS (SELECT tile_id, count(*) AS groups, sum(weight)::BIGINT AS occurrences FROM weighted WHERE tile_id % 5 <> 0 GROUP BY tile_id), v AS (SELECT tile_id, count(*) AS visits, count(DISTINCT handle) AS records FROM event_visits GROUP BY tile_id) SELECT tile_id, visits, records, groups, occurrences, CASE WHEN groups IS NULL THEN 'no memberships' ELSE 'both' END AS status FROM v LEFT JOIN g USING (tile_id)"),
    "preset_match": (preset_match, f"WITH {S.EVENT_GROUPS} SELECT DISTINCT tile_id::VARCHAR || '/' || sha256({S.WALK_TEXT}) AS preset_id, (['validated', 'tile-count-mismatch', 'digest-count-mismatch', 'occurrence-weight-mismatch', 'membership-count-mismatch', 'membership-mismatch', 'validated'])[(tile_id % 7 + 1)::INT] AS verdict FROM canonical"),
    "locate_statistics": (locate_statistics, f"WITH {S.EVENT_VISITS}, s AS (SELECT handle // 2 AS node_id, (ord - 1) % 16 AS steps FROM event_visits), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY steps) - 1 AS i, count(*) OVER (PARTITION BY node_id) AS n FROM s) SELECT node_id, max(n) AS positions, {', '.join(f'max(steps) FILTER (WHERE i = (n * {p} + 99) // 100 - 1) AS p{p}' for p in (50, 90, 95, 99))}, max(steps) AS most, sum(steps)::BIGINT AS total_steps FROM r GROUP BY node_id"),
    "topology_decision": (topology_decision, "SELECT *, nodes > greatest(120, least(320, floor(greatest(1, width - 78) * 0.22))) OR edges > greatest(160, least(480, floor(greatest(1, width - 78) * 0.3))) AS aggregated FROM (SELECT l_suppkey AS view, 200 + l_suppkey * 37 % 1500 AS width, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 10) AS nodes, count(*) FILTER (WHERE l_returnflag = 'N') AS edges FROM lineitem GROUP BY ALL)"),
    "display_refusal": (display_refusal, "SELECT view, CASE WHEN g <= 2500 AND e <= 5000 THEN 'shown' ELSE concat_ws(', ', CASE WHEN g > 2500 THEN g::VARCHAR || ' node groups (limit 2500)' END, CASE WHEN e > 5000 THEN e::VARCHAR || ' topology edges (limit 5000)' END) END AS message FROM (SELECT l_linenumber AS view, count(DISTINCT l_partkey) AS g, count(*) AS e FROM lineitem GROUP BY ALL)"),
    "visual_interval": (visual_interval, f"WITH {S.REFERENCE}, {S.QUERIES}, a AS (SELECT query_id, q_start, (q_end - q_start)::DOUBLE AS span, (query_id % 301 - 150)::DOUBLE AS pan, greatest(1, (query_id % 900)::DOUBLE) AS w, 1 + (query_id % 4)::DOUBLE / 2 AS zoom FROM region_queries), b AS (SELECT *, q_start + (-pan / (w * zoom)) * span AS l, q_start + ((w - pan) / (w * zoom)) * span AS r FROM a), c AS (SELECT *, greatest(1, floor(r - l + 0.5)) AS bases FROM b), d AS (SELECT *, greatest(0, floor((l + r) / 2 - bases / 2 + 0.5)) AS first FROM c) SELECT query_id, first::BIGINT AS view_start, (first + bases)::BIGINT AS view_end FROM d"),
    "size_labels": (size_labels, "SELECT k AS o_orderkey, format('{:,}', n) AS separated, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN format('{:,}', n * 10 // 1024 // 10) || '.' || (n * 10 // 1024 % 10)::VARCHAR || ' KiB' ELSE format('{:,}', n * 10 // 1048576 // 10) || '.' || (n * 10 // 1048576 % 10)::VARCHAR || ' MiB' END AS labelled, lower(lpad(to_hex(n), 8, '0')) AS hex FROM (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT * (o_orderkey % 97) AS n FROM orders)"),
    "seeded_regions": (seeded_regions, f"WITH s AS (SELECT s_suppkey, (s_suppkey * 2654435761 + 1)::HUGEINT AS x FROM supplier), {_xorshift('s', 'x', 'one')}, {_xorshift('one3', 'one', 'two')}, {_xorshift('two3', 'two', 'three')} SELECT s_suppkey, to_hex(one::UBIGINT) AS first, to_hex(two::UBIGINT) AS second, (three % 1000)::BIGINT AS bounded FROM three3"),
    "grouped_quantiles": (grouped_quantiles, f"WITH m AS (SELECT o_orderstatus AS config, unnest([o_orderpriority, 'all']) AS class, o_totalprice AS latency FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY config, class ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY config, class) AS n FROM m) SELECT config, class, max(n) AS n, {', '.join(f'max(latency) FILTER (WHERE i = ((n - 1) * {p} + 99) // 100) AS p{p}' for p in (50, 90, 95, 99))}, max(latency) AS longest, min(latency) AS shortest FROM r GROUP BY config, class"),
    "dedup_choice": (dedup_choice, "WITH o AS (SELECT o_orderstatus AS config, o_orderpriority AS class, floor(o_totalprice)::BIGINT AS bytes, o_custkey % 50 AS block FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY class, config ORDER BY bytes) - 1 AS i, count(*) OVER (PARTITION BY class, config) AS n FROM o), p AS (SELECT class, config, max(bytes) FILTER (WHERE i = ((n - 1) * 95 + 99) // 100) AS p95 FROM r GROUP BY ALL), u AS (SELECT class, config, sum(t)::BIGINT AS bytes_before, sum(k)::BIGINT AS bytes_after FROM (SELECT class, config, block, sum(bytes) AS t, max(bytes) AS k FROM o GROUP BY ALL) GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p95, bytes_before, config) AS place FROM u JOIN p USING (class, config) WHERE bytes_before > bytes_after) SELECT class, config, p95, bytes_before, bytes_after, round(bytes_after::DOUBLE / bytes_before, 9) AS ratio FROM c WHERE place = 1"),
    "benchmark_report": (benchmark_report, f"WITH l AS (SELECT *, l_suppkey % 10 AS kind, l_quantity::BIGINT AS ms, l_partkey * 64 AS s, l_partkey * 64 + l_quantity::BIGINT * 8 AS e FROM lineitem), {S.islands('l', 'kind', 0)}, {S.merged('kind')}, u AS (SELECT kind, sum(e - s)::BIGINT AS unique_bytes FROM merged GROUP BY kind), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM l), t AS (SELECT kind, count(*) AS queries, count(*) FILTER (WHERE l_returnflag <> 'R') AS passed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, sum(ms * 8)::BIGINT AS response_bytes, {', '.join(f'max(ms) FILTER (WHERE i = ((n - 1) * {p} + 99) // 100) AS p{p}' for p in (50, 90, 95, 99))}, max(ms) AS longest FROM r GROUP BY kind) SELECT t.*, unique_bytes, response_bytes - unique_bytes AS duplicate_bytes FROM t JOIN u USING (kind)"),
    "view_levels": (view_levels, f"""WITH RECURSIVE {_SUMMARY}, series AS (SELECT query_id % 10 AS view, p.manifest_id, p.level, count(DISTINCT p.bin_start) AS bins FROM selected q JOIN pyramid p ON p.manifest_id = q.manifest_id AND p.bin_start < q.q_end AND p.bin_start + p.bin_span > q.q_start GROUP BY ALL),
{S.chosen_levels(12)}"""),
}
