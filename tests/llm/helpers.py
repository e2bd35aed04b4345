"""Small tables and brute-force versions shared by the tests of this folder."""

import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like results or internals of the operators.
CLASHING = "n_lines string, n_words string, score string, fp string, component_id string, row string, target string, text2 string, spans string"


def documents(spark, rows, clashing=False):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    if not clashing:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, *["x"] * 9) for r in full], f"{SCHEMA}, {CLASHING}")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def groups(links):
    """Smallest member of the component of every node in ``links`` (pairs, self pairs for loners)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def words(n, seed):
    """``n`` random words."""
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]
