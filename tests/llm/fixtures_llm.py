"""Documents with every odd case: nulls, empty and long texts, copies, near copies, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, _measured int, shard string"


def prose(seed: int, n: int, start: str = "") -> str:
    rng = random.Random(seed)
    syllables = "ka lo mi re tu sa ne po vi da gu he".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return start + " ".join(words)


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(" ", "  ", 3).split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one two three"), (8, "ONE two Three"), (9, prose(2, 4000)), (10, prose(3, 80)),
        (11, prose(3, 80)), (12, "x" * 50_000), (13, "日本語 テキスト です " * 40), (14, prose(4, 60)), (14, prose(4, 60)), (15, "idiot " + prose(5, 70)), (16, prose(6, 70) + " scum"),
        (None, prose(7, 90)), (17, "a\u0000b \x01\x02 c"), (18, "### | *** <|endoftext|> $5 & it's 'quoted' é É"), (20, prose(8, 2500)), (21, "word " * 300), (22, "line one\nline two\nline one\n\nline one"),
    ]
    return [(i, t, "en" if i and i % 2 else None, "src0", -1, "k", "s", 1, "x") for i, t in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
