import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 7919} x{i % 13}" for i in range(15_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
# null id, null and empty texts, blanks only, a very long text, copies, repeated rows, one passage
# in many texts, capitals, other alphabets, and a text with the words of a benchmark item
ROWS = [
    (1, "The cat sat on the mat and the dog sat on the log by the old mill today"),
    (2, "The cat sat on the mat and the dog sat on the log by the old mill today"),
    (2, "The cat sat on the mat and the dog sat on the log by the old mill today"),
    (3, "the CAT sat on the mat and the dog sat on the log by the old mill today"),
    (4, None), (5, ""), (6, " \t\n "), (None, "no id here"), (None, None),
    (7, LONG), (8, LONG + " tail"), (9, "one"), (10, "one"), (11, "ONE"), (12, "é ü 漢字 ١٢٣ ñ"),
    (13, f"before it {PASSAGE} and after"), (14, f"other words {PASSAGE}"), (15, PASSAGE),
    (16, f"{PASSAGE} {PASSAGE}"), (17, "it's John's!! 'll they've  done\n\n  'tis 42% of £3"),
    (18, "a b c d e f g h i j k l m n o p q"), (19, "x a b c d e f g h i j k l m y"),
    (20, "<|endoftext|> is plain text \x1c\x85\xa0 and ￿ too"),
]
CLASH = ("text_hash", "spans", "may_lose", "may_go", "gone_id", "place", "n", "class", "window",
         "owner", "shard", "h", "block", "rank", "score", "row", "word")


def table(spark, rows, parts=3):
    """Documents with extra columns whose names operators use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"),
                             "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    table(spark, ROWS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def known(docs):
    """Only rows with an id."""
    return docs.where("doc_id is not null")
