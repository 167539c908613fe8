"""The SQL of the operators that have it, on small tables with edge rows, against their queries."""

import random

import duckdb
import pytest

from engramlake.llm.queries import ORACLES, QUERIES

R = random.Random(11)
WORDS = "the work is licensed under a creative commons license Mit GNU general public all rights reserved released software free é😀 cc by".split()
IBANS = ["BE68 5390 0754 7034 BANK", "BE68539007547034 OK", "ES91 2100 0418 4502 0005 1332 BIC", "konto DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", "XBE68539007547034 BE685390075470341 be68539007547034", "DE89370400440532013000DE89370400440532013000", "NO93 8601 1117 947 NO9386011117947"]
TEXTS = [None, "", "\n", *IBANS, "mail a@b.co 10.0.0.1 4111 1111 1111 1111 +1 555 123 4567", "x" * 5000, "cc by cc by\ncc\nby"]
TEXTS += ["\n".join(" ".join(R.choice(WORDS) for _ in range(R.randrange(0, 14))) for _ in range(R.randrange(1, 9))) for _ in range(60)]
TEXTS += [f"shared line\nown {i}\n Shared LINE " for i in range(12)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    turns = [(c, t, R.choice(["user", "assistant", "a <|x", None]), R.choice([None, "", "hi <|im_end|>", "é"])) for c in range(5) for t in range(R.randrange(1, 140))] + [(None, 1, "user", "x"), (3, None, "user", "y")]
    turns += [(c, t, R.choice(["user", "assistant", "system", "tool", ""]), R.choice(["Yes.", "no", "No!", "", " \t", "é?", None])) for c in range(5, 40) for t in range(R.randrange(0, 7))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    centres = [[R.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    vectors = [(i * 5, R.choice([[x + R.gauss(0, 0.3) for x in R.choice(centres)], centres[0]]), R.randrange(4)) for i in range(300)]
    vectors += [(1700, None, 1), (1800, [1.0], 1), (1900, [float("nan")] * 6, 1), (2000, [1.0] * 5 + [None], 1), (2100, [1.0] * 6, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, tables, name):
    got = QUERIES[name](spark, tables)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables.removeprefix('file://')}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    row = lambda values: tuple(round(v, 9) if isinstance(v, float) else v for v in values)
    ours = sorted((row(r[c] for c in columns) for r in got.collect()), key=str)
    assert ours == sorted((row(r) for r in want.fetchall()), key=str) and len(ours) > 20


def test_ibans_before_other_words(spark, tables):
    got = {r.doc_id: r.spans for r in QUERIES["op2_pii"](spark, tables).collect()}
    assert [got[i].count("iban:") for i in range(3, 10)] == [1, 1, 1, 2, 0, 0, 2]
    assert got[3] == "iban:0:19" and got[5] == "iban:0:29"
