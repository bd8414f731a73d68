"""Workers run the operators without a copy of the package."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {here!r})
import __spark_entry__ as e
from plumbline.session import local_session
spark = local_session(2)
for key in {keys!r}:
    assert e.queries()[key](spark, {sf_dir!r}).count() > 0, key
"""


@pytest.mark.parametrize("keys", [("knn_classify", "op1_exact_dedup", "op2_substring_dedup", "op4_lm_scoring"), ("op8_token_store", "pipeline")])
def test_queries_run_from_any_folder(tmp_path, sf_dir, keys):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(here=HERE, keys=keys, sf_dir=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-1500:]
