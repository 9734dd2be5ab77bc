from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, row string, id long, digest string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def make_docs(seed: int = 1) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): copies, near copies, shared passages, runs, periodic and odd texts, nulls, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out: list[tuple[int | None, str | None, str | None]] = []
    for k in range(60):
        out.append((k, prose(rng, rng.choice([1, 3, 4, 5, 6, 19, 20, 21, 25, 60, 200])), f"s{k % 5}"))
    base = prose(rng, 150)
    for k in range(60, 75):  # near copies in a chain: each a few words from the one before
        words = base.split()
        words[rng.randrange(150)] = "changed"
        base = " ".join(words)
        out.append((k, base, "s0"))
    out += [(k, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30), None) for k in range(75, 85)]
    out += [(k, passage.upper() if k % 2 else passage, "s1") for k in range(85, 90)]
    out += [(90, "a " * 90, "s2"), (91, "b " + "a " * 40 + "c", "s2"), (92, "x y z " * 30, "s3"), (93, "x  y\tz\n" * 25, "s3"), (94, prose(rng, 5000, 50), "s3")]
    out += [(95, None, "s4"), (96, "", None), (97, " \t\n ", "s4"), (98, "Ünïcödé naïve — 文字 \U0001f600 " * 10, "s4"), (99, " nbsp  stays", "s4")]
    out += [(100, out[3][1], "s1"), (100, out[3][1], "s1"), (101, out[59][1], "s1"), (None, out[59][1], "s2"), (None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs():
    return make_docs()


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame with extra columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, "x", 7, "x") for i, t, s in rows], SCHEMA)

    return build
