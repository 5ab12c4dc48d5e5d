"""Rows of edge cases."""

CLASHING = "size row removed n_lines labels bucket next node _copy d t h k1 k2 s1 s2 root u v _w _h kept probability score piece start part rank path met gone head head_fingerprint class_id keeper weight".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing songs about rivers and hills".split()


def words(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies; columns that clash."""
    extra = tuple(range(len(CLASHING)))
    long_ = words(60_000, 1)
    passage = words(70, 2)
    out = [
        (1, words(120, 3), "en", "a"),
        (2, words(40, 4) + "\n" + passage + "\nend of this", "en", "a"),
        (3, words(50, 5) + "\n" + passage + "\nMIT License.\nsomething else", "de", "b"),
        (4, words(120, 3).replace("fox", "cat", 1), None, "b"),
        (5, words(120, 3), "en", None),
        (6, "", "en", "a"),
        (7, None, "en", None),
        (8, " \n\t ", None, "c"),
        (9, long_, "en", "c"),
        (10, "one two", "en", "c"),
        (10, "one two", "en", "c"),
        (None, words(80, 6), "en", "a"),
        (None, None, None, None),
        (12, "Licensed under the Apache License, Version 2.0.", "en", "b"),
        (13, "x" * 300_000, "en", "b"),
        (14, "İstanbul \U0001f600 <|endoftext|> ﬁn e   漢字", "tr", "b"),
        (15, "\n".join(["same line here"] * 2000), "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in out]


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, kind int, block int, x int"


def vectors() -> list[tuple]:
    """Nulls, wrong lengths, not finite, huge, repeated rows, ties; columns that clash."""
    import math

    def row(i, v):
        return (i, v, 0, 1, 2, 3, 4)

    plain = [[math.sin(i * 64 + k) for k in range(64)] for i in range(30)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None, *[1.0] * 63], [math.nan, *[1.0] * 63], [math.inf, *[1.0] * 63], [*[1.0] * 63, -math.inf]]
    out = [row(i, v) for i, v in enumerate(plain)] + [row(100 + i, v) for i, v in enumerate(odd)]
    return [*out, row(3, plain[3]), row(3, plain[3]), row(3, plain[4]), row(None, plain[5]), row(50, [3e38, *[-3e38] * 63]), row(51, [3e38, *[-3e38] * 63]), row(52, [1e12] * 64), row(53, [0.0] * 64), row(54, [-0.0] * 64)]
