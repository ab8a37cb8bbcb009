"""Small tables with the odd cases every operator must take."""

import random

import pytest


def odd_texts():
    rnd = random.Random(11)
    words = [f"wort{i}" for i in range(80)] + ["Éan", "x" * 400, "##", "!!"]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = ["\n".join(line(rnd.randint(0, 12)) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    block = "\n".join(line(8) for _ in range(5))
    texts += [f"{line(5)}\n{block}\n{line(4)}" for _ in range(6)] + [block, block, f"{block}\n\n{block}"]
    texts += ["", None, " \n\t\r\n", "one", "a b c d e f g h " * 6, "\n".join(["same line here"] * 9), line(3000)]
    return texts


def documents(spark, extra=True):
    rows = [(i * 13 % 997, t, "en", f"src{i % 3}", len(t or ""), "clash") for i, t in enumerate(odd_texts())]
    cols = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    df = spark.createDataFrame(rows, cols)
    return df if extra else df.drop("n_words")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of Parquet tables, as the oracle reads them."""
    folder = tmp_path_factory.mktemp("tables")

    def write(**frames):
        for name, df in frames.items():
            df.toPandas().to_parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
