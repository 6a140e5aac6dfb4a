from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, bucket int, kept string, score int, length int, part string, others string, fp int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    known = ["".join(rnd.choice("abcdefgilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(vocabulary)]
    out = [rnd.choice(known) + rnd.choice(["", "", "", ",", ".", ".\n"]) for _ in range(words)]
    return " ".join(out)


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    passage = prose(99, 60)
    near = prose(5, 200).split(" ")
    out: dict[int, str | None] = {
        0: None, 1: "", 2: " \n\t ", 3: "a", 4: "Ünïcode ß İ Σ. 日本語 🙂 the end", 5: prose(5, 200), 6: prose(5, 200), 7: " ".join([*near[:100], "CHANGED", *near[101:]]),
        8: prose(8, 120) + " " + passage, 9: passage.upper(), 10: prose(10, 30) + "  double  spaces\t" + passage + " tail", 11: prose(11, 20_000), 12: "!!! ### $$$ |||",
        13: "same words same words same words same words " * 30, 14: "<|endoftext|> it's a test, isn't it? 3.14", 15: "x" * 5000, 16: passage[:49], 17: passage[:50],
    }
    out |= {i: prose(i, 40 + i) for i in range(20, 60)}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every edge case, with a repeated row, null columns and clashing extra columns."""
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], None if i % 4 == 0 else f"s{i % 2}", len(t) if t is not None else None, "r", 1, "k", 2, 3, "p", "o", 4) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[5]], COLUMNS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)
