"""Small documents with the awkward cases, and extra columns whose names clash with results'."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, shard int, id long, n_words long, sequence_id long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, short, empty, null and very long texts, repeated rows, null ids."""
    rng = random.Random(5)
    base, passage = words(rng, 120, 5000), words(rng, 70, 5000)
    out = [(10, base), (3, base), (11, base), (12, base + " tail"), (13, base.replace(" ", "\n", 5)), (14, base.upper())]
    out += [(20 + k, f"{words(rng, 60, 5000)} {passage} {words(rng, 40, 5000)}") for k in range(6)]
    near = base.split()
    for k in range(12):
        changed = list(near)
        changed[rng.randrange(len(changed))] = f"x{k}"
        out.append((40 + k, " ".join(changed)))
    chain = words(rng, 100, 5000).split()
    for k in range(6):  # each links with the next only
        out.append((60 + k, " ".join(chain[8 * k:] + [f"c{j}" for j in range(8 * k)])))
    out += [(70, ""), (71, None), (72, " \t\n "), (73, "one two"), (74, "one two"), (75, "a b c d"), (76, "non\u00a0breaking\u2003space \x1c here")]
    out += [(80, words(rng, 20000, 5000)), (81, "a " * 3000), (82, "x" * 50000)]
    out += [(90, words(rng, 30)), (90, words(rng, 30)), (91, base), (91, base), (None, base), (None, passage)]
    return out


def documents(spark, rows=None, clash=True):
    rows = corpus() if rows is None else rows
    full = [(i, t, "en", "s", None if t is None else len(t), True, -1, 3, 7, 9, 2) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")


def tokens(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()
