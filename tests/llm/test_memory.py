"""What Python workers hold between tasks, each measured in a process of its own."""

import subprocess
import sys

import pytest

HELD = """
import re
from pathlib import Path

import pyarrow as pa

import loamgrid.llm.language_id, loamgrid.llm.packing, loamgrid.llm.secret_scan, loamgrid.llm.similar

class Source:
    schema = None
    def mapInArrow(self, run, schema):
        self.run = run

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
"""


def said(code: str) -> list[float]:
    got = subprocess.run([sys.executable, "-c", HELD + code], capture_output=True, text=True, timeout=120)
    assert not got.returncode, got.stderr
    return [float(x) for x in got.stdout.split()]


def test_a_task_gives_back_what_it_freed():
    before, after = said(
        """
from pyspark.sql.types import LongType, StringType, StructField, StructType
from loamgrid.llm.secret_scan import redact_documents

s = Source()
s.schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
redact_documents(s)
def batches():
    for _ in range(3):
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(40_000)), "text": [f"{i} lorem ipsum " * 40 for i in range(40_000)]})
for _ in s.run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x"]})])):
    pass
print(held())
for _ in s.run(batches()):
    pass
_ = None
print(held())
"""
    )
    assert after - before < 15


def test_the_next_operator_starts_without_the_language_tables():
    before, after = said(
        """
import random
from loamgrid.llm._shared import take_turn
from loamgrid.llm.language_id import score_texts

rng = random.Random(3)
key = tuple((k, "".join(rng.choices("abcdefghijklm ", k=30_000))) for k in "abcd")
score_texts(["warm"], (("a", "some words"),))
take_turn()
print(held())
score_texts(["a few words of text"], key)
take_turn()
print(held())
"""
    )
    assert after - before < 15


@pytest.mark.parametrize("texts", [[], [None, "", "a b c"], ["x " * 50] * 300])
def test_turns_leave_the_rows_as_they_are(spark, texts):
    from loamgrid.llm.packing import pack_documents
    from loamgrid.llm.secret_scan import redact_documents
    from loamgrid.llm.tokens import default_vocabulary

    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, redact_documents(d).collect())) == [*enumerate(texts)]
    got = pack_documents(d, default_vocabulary()).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == len(texts) and all(r[1] == r[2] for r in got)
