"""Invented texts for the corpus tests."""

import itertools
from collections import Counter


VOCABULARY = "the of and to in is that for it as was with be by on not he his but at".split()
ENDINGS = ["", "s", "er", "ing", "ly", "ed"]


def words(rng, n, vocabulary=VOCABULARY):
    return " ".join(rng.choice(vocabulary) + rng.choice(ENDINGS) + str(rng.randrange(40)) for _ in range(n))


def brute_lines(texts, least):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if count[key(x)] < least) for t in texts]


def brute_components(texts, part=75, whole=100):
    def grams(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split() if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]
