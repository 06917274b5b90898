"""The queries run where workers have neither the package nor its folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

CODE = """
import sys
sys.path.insert(0, {root!r})
from tastegrid.session import local_session
import __spark_entry__
spark = local_session("workers", cores=4, partitions=4, memory="4g")
def absent(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("tastegrid") is None
        yield b
assert spark.range(3).mapInArrow(absent, "id bigint").count() == 3
for name in ("op3_langid", "op5_pii", "op7_hmm", "op8_neighbours", "op9_wrapper", "op11_order_minhash", "op12_repair", "op13_variants"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=900)
    assert done.returncode == 0, done.stderr[-2_000:]
