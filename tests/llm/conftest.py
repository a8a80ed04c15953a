import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import prose  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, score double, h1 long, rid long, parts string, `key` string, runs int, toxic int, c0 string, id string"
CLASH = ("x", 1, 0.5, 2, 3, "p", "k", 4, 1, "c", "i")


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *CLASH)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, equal texts, clashing columns."""
    same = prose(1, 60)
    rows = [
        row(1, None), row(2, ""), row(3, "  \n\t "), row(4, "!!! ... ###"), row(5, same), row(6, same), row(6, same),
        row(None, same), row(None, None), row(7, "x" * 300_000), row(8, prose(2, 40_000)), row(9, "é ß ñ 漢字 😀 <|endoftext|> a\x00b", None, None),
        (10, "one two", None, None, None, *[None] * 11), row(11, "tie tie tie tie tie tie tie tie tie tie"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts():
    """Prose with exact and near copies."""
    out = [prose(i, 30 + i % 50) for i in range(60)]
    rng = random.Random(9)
    for i in range(40):
        words = prose(100 + i % 4, 200).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + out[:10]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCS)
