"""Documents with everything odd in them, and plain ways to the same results."""

import numpy as np

WORDS = "the of and river stone light over under garden winter paper silver open quiet north table seven cloud ember field".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    made = [WORDS[i] if i < len(WORDS) else f"w{i}" for i in rng.integers(0, 60, n)]
    return " ".join(f"{w}.\n" if k % 15 == 14 else w for k, w in enumerate(made))


LONG = prose(77, 9000)
TEXTS = [
    prose(1, 300),
    prose(1, 300),
    prose(1, 150) + " changed here " + prose(2, 150),
    prose(3, 400),
    "",
    None,
    "   \n\t ",
    "one",
    "two words",
    "x" * 5000,
    "a b " * 700,
    LONG,
    "Ünïcode ΣΑΣ 中文 😀 " * 30,
    "- - - -\n" * 200,
    prose(4, 100) + prose(1, 300),
    "<|endoftext|> </s>[INST] \\ ok",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, fp int, kept string, slot int, _rid int, body int"


def rows():
    out = []
    for i, t in enumerate(TEXTS):
        lang, source = ("en", "s1") if i % 3 else (None, None)
        out.append((i, t, lang, source, len(t or ""), "p", i, "k", i, None, 0))
    out.append(out[0])  # a repeated row
    out.append((None, "no id here at all", "en", "s2", None, None, None, None, None, 5, None))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
