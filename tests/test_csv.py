"""Quoted CSV in pieces: every cut gives the rows of an undivided read."""

import csv
import io
import random

import pytest

from docsieve.session import scratch_path
from docsieve.sources import quoted_csv, readers

HEADER = "abstract,mesh_terms,publication_types,title,pmid\n"
BODY = (
    '"a ""q"" b\n\nline, two\n",m,,"t\n",1\nplain,,"","x ""\n"" y",2\n\n"only\none",b,c,d,3\n,,,,4\n'
    'end,"""",,"",5\n"\n\n\n",",,","""\n""",é漢字,6\n'
)


@pytest.fixture
def pieces(spark):
    """Sets the size of the pieces files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def cut(size):
        for name, value in zip(names, (size, 0, 1)):
            spark.conf.set(name, str(value))

    yield cut
    for name in names:
        spark.conf.unset(name)


def write(path, name, text):
    import os

    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", encoding="utf-8", newline="") as out:
        out.write(text)


def undivided(spark, path):
    reader = spark.read.schema(readers.DOCUMENT_SCHEMA).option("header", True).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [10_000, 61, 17, 6])
def test_every_cut_gives_the_same_rows(spark, pieces, size):
    path = scratch_path(spark, "csv").removeprefix("file:")
    write(path, "one.csv", HEADER + BODY)
    write(path, "two.csv", HEADER + '"last\n""record""\nwithout end",a,b,c,9')
    write(path, "three.csv", HEADER)
    want = rows(undivided(spark, path))
    pieces(size)
    if size < 100:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
    assert rows(readers.read_documents_csv(spark, path)) == want and len(want) == 7


def test_generated_files(spark, pieces):
    rng = random.Random(4)
    values = ["", "x", "a,b", 'say "hi"', "two\nlines", '"', '"\n"', "\n", "tail \n\n", "é,\n漢"]
    table = [[rng.choice(values) for _ in range(4)] + [i] for i in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_NONNUMERIC).writerows(table)
    path = scratch_path(spark, "csv").removeprefix("file:")
    write(path, "made.csv", HEADER + out.getvalue())
    pieces(211)
    got = {r.pmid: tuple(r)[:4] for r in readers.read_documents_csv(spark, path).collect()}
    assert {k: tuple(x or "" for x in v) for k, v in got.items()} == {r[4]: tuple(r[:4]) for r in table}


def test_states_of_pieces(spark, pieces):
    path = scratch_path(spark, "csv").removeprefix("file:")
    write(path, "x.csv", 'h\n"aaaa\nbbbb\ncccc\ndddd"\neeee\n"f\nf"\n')
    pieces(6)
    states = quoted_csv._states(quoted_csv._lines(spark, path)).orderBy("block").collect()
    whole = open(f"{path}/x.csv").read()
    for r in states:  # a piece's lines are those that begin after its first byte
        start = 0 if r.block == 0 else whole.index("\n", r.block) + 1
        assert r.inside == whole[:start].count('"') % 2
