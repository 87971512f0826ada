import random

import pytest

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, h STRING, kept INT, spans STRING, part STRING"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "house", "light", "über", "façade", "tree"]) + rng.choice(["", "", ",", "."])
                    for _ in range(n))


def awkward_rows(seed=5):
    """NULLs, empty and long texts, exact and near copies, repeated rows and ids, ties, odd characters."""
    rng = random.Random(seed)
    long = words(rng, 3000)
    base = "\n".join(words(rng, 12) for _ in range(9))
    edited = base.replace("river", "stream", 1)
    texts = [
        None, "", " ", "\n\n\n\n", "word", "two words", "\t lead and trail \r\n", base, base, edited, base + "\n" + words(rng, 12),
        long, long[:9000] + " changed " + long[9000:], long + "\n" + base, "a" * 500, "ab" * 300, "😀 émoji ﷽ text", "12345 67890",
        "same line\n" * 12, words(rng, 40), words(rng, 41), "x\x00y <|endoftext|> z  two  spaces \n here", "don't WON'T I'm 3rd 1,000.50",
        "mail a.b+c@d-e.example.org now", "tel +1 (456) 555-2186, card 4111 1111 1111 1111 ip 10.0.0.256 or 10.0.0.25",
    ]
    langs = [None, "en", "de", "fr"]
    rows = [(i, t, langs[i % 4], None if i % 7 == 3 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", "en", "src1", 17), (None, base, "en", "src1", 1), (7, "second text of id seven", "en", "src0", 23), rows[7], rows[7], rows[1]]
    return [(*r, "clash", 1, "s", "p") for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def plain_rows():
    """Distinct ids, texts without NULL: what brute force compares against."""
    seen = {}
    for row in awkward_rows():
        if row[0] is not None:
            seen.setdefault(row[0], row[1] or "")
    return sorted(seen.items())


@pytest.fixture(scope="session")
def plain(spark, plain_rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t), "c", 1, "s", "p") for i, t in plain_rows], COLUMNS)
