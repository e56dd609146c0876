"""Small document tables for the corpus operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lost string, score double"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(4)
    long = " ".join(words(rng, 30_000))
    plain = ". ".join(" ".join(words(rng, 9)) for _ in range(12)) + "."
    texts = [
        None, "", " \t\n\r\x0b\x0c ", "one", "a b c", "x\x00y <|endoftext|> z", "日本語のテキスト。　もう一つ", "É́ß ﬁ퟿ 𝔘𝔫𝔦", "\n\n\n", plain, plain,
        plain.upper(), plain + "\n" + plain, long, long, "a " * 20_000, "!!! ### $$$", "z" * 50_000,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), None, None) for i, t in enumerate(texts)]
    rows += [(None, plain, None, None, None, "x", 1.0), (None, None, None, None, None, None, None)]
    rows += [rows[9], rows[9], (9, "another text with the same number as one above", "de", "s1", 3, "y", 0.5)]
    return rows


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
