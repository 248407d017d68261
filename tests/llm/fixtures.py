"""Small document tables with every kind of awkward row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, x int, score double, kept boolean, set_key string, text_key string, band long, words array<string>, h long, k long, t string, tie long, own long, size long, text_to_encode string, text_to_score string, bad_doc_id long, bad_text_key string, kept_doc_id long, kept_text_key string, n_tokens long, part int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeorstué") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): copies, near copies at and about the threshold, nulls, empty and white-space texts, one very long text, repeated rows, a null id."""
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 5, 40, 60, 120, 200)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.upper() if t.isascii() else t) for i, t in enumerate(base)]
    for k in range(30):
        w = base[3 + k % 3].split()
        for _ in range(1 + k % 6):
            w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "One"), (305, words(rng, 30_000)), (None, base[4]), (None, words(rng, 20)), (None, None)]
    return rows + [rows[2], rows[2], (None, base[4])]


def table(spark, rows):
    """Rows with the columns of documents and others whose names the operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 1, 0.5, False, "k", "tk", 7, ["w"], 1, 2, "t", 3, 4, 5, "e", "s", 6, "b", 7, "k", 8, 9) for i, t in rows], SCHEMA)
