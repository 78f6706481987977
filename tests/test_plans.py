"""Tables in the shared folder, with and without a setting, and rows whose order ties."""

import os
import subprocess
import sys
import tempfile

from millrace.operators import documents as D
from tests.conftest import ROOT

PROGRAM = """
from millrace.session import build_session
from millrace.plans.materialize import free, materialize, shared_dir
spark = build_session("bare", "local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
table = materialize(spark.range(10))
assert table.count() == 10 and shared_dir(spark) == shared_dir(spark)
free(table)
print("done")
"""


def test_a_session_without_any_setting_materializes():
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM], capture_output=True, text=True, env=env, timeout=300, check=False)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]


def test_merged_assets_with_ties_and_unknown_hashes(spark):
    rows = [(1, 0, "i", "x", 1), (1, 0, "i", "x", 1), (1, 1, "i", "y", 1), (1, 1, "i", None, 2), (2, 0, "i", None, 1), (2, 1, "i", None, 1), (3, 0, "i", "b", 1), (3, 0, "i", "a", 1)]
    out = D.merge_assets(spark.createDataFrame(rows, "doc int, slice int, name string, sha string, seq int"), "doc", "slice", "name", "sha", ["seq"])
    got = sorted((r.doc, r.slice, r.sha or "", r.new_name) for r in out.collect())
    assert got == [(1, 0, "x", "i"), (1, 1, "", "b1_i"), (1, 1, "y", "b1_i"), (2, 0, "", "i"), (2, 1, "", "b1_i"), (3, 0, "a", "i"), (3, 0, "b", "b0_i")]


def test_markdown_that_holds_marks_of_its_own():
    text = "a \x000\x00 b\n```\ncode\n```\n\x00\x00"
    assert D.format_markdown(text).count("code") == 1
