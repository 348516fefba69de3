"""Operators in tasks whose Python cannot import this package."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # of this process alone: workers have neither this path nor the repository as their folder
from salescope.session import build_session
from salescope.llm import jaccard_join, lexical_search, simhash, substring_dedup
spark = build_session("local[2]", 2)

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("salescope") is not None])], ["found"])

assert not any(r[0] for r in spark.range(4).mapInArrow(importable, "found boolean").collect())
text = "one two three four five six seven eight nine ten eleven twelve " * 3
docs = spark.createDataFrame([(1, text), (2, text + "more"), (3, "other words here"), (4, None)], "doc_id long, text string")
items = spark.createDataFrame([(7, "nine other")], "item_id long, text string")
found = jaccard_join.similar_components(docs, 3, 60).collect()
assert {{r.doc_id: r.component_id for r in found}} == {{1: 1, 2: 1, 3: 3, 4: 4}}, found
assert simhash.simhash_components(docs).count() == 4
assert {{r.doc_id for r in lexical_search.lexical_search(docs, items).collect()}} == {{1, 2, 3}}
assert substring_dedup.remove_repeats(docs).count() == 4
print("all ran")
"""


def test_tasks_need_no_package(scratch):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=scratch, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
