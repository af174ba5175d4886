"""Small tables of hard cases, shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def hard_rows(seed=1):
    """Nulls in any column, empty and long texts, ties, repeated rows; further columns whose names clash."""
    rng = random.Random(seed)
    a, b = prose(rng, 120), prose(rng, 80)
    line = "This line stands in several of the documents."
    texts = [
        a, a.upper(), a + " tail", b, b, None, "", " ", "\n", "\n\n", "x", "Üñïçødé " * 30, "日本語のテキスト" * 40, "a" * 3000,
        f"{line}\nown words here one\n{line}", f"  {line.upper()}\t\nown words here two", f"{line}\n", f"{line}\nlast of them",
        prose(rng, 4), prose(rng, 5), prose(rng, 20_000), "\x1f\x0b odd\x0cspaces\r\nand lines\r\n", "é" * 20, "É" * 15, "<|endoftext|> it's <|startoftext|>",
    ]
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "kept", "size", "row") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, a, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (9, "same id, another text, of some words", None, "s1", None, None, None, None)]
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def norm(rows):
    return sorted((tuple(r) for r in rows), key=repr)
