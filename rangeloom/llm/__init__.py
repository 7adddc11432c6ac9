"""Training-corpus operators: each module holds one operator; `queries` registers them."""
