"""The HTTP routes without sockets, and the driver's contract with and without the optional subpackage."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from attestra.plans.server import App

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_routes(spark):
    app = App(spark)
    call = lambda m, u, b=b"": (lambda r: (r[0], json.loads(r[2]) if r[1] == "application/json" else r[2]))(app.handle(m, u, b))
    assert call("GET", "/api/health")[0] == 200 and call("GET", "/")[0] == 200
    assert call("POST", "/api/doctor")[0] == 400 and call("GET", "/api/nope")[0] == 404 and call("GET", "/api/campaign/zz")[0] == 404
    csv = "x,z,label\n" + "\n".join(f"{i % 37 + i / 7},{(i * i) % 53},{int(i % 10 == 0)}" for i in range(200))
    status, told = call("POST", "/api/ingest?name=t.csv", csv.encode())
    assert (status, told["label"], told["n_rare"]) == (200, "label", 20)
    assert call("POST", "/api/doctor?label=label&value=1")[0] == 200
    assert call("POST", "/api/propose")[1]["label"] == "label"
    assert call("POST", "/api/generate?intent=wild")[0] == 400
    status, run = call("POST", "/api/generate?rows=40&auto=false&intent=faithful&privacy=none")
    assert status == 200 and run["n_rare"] == 10
    assert len(call("GET", f"/api/campaign/{run['id']}/preview?n=3")[1]) == 3
    assert call("GET", f"/api/campaign/{run['id']}/download")[1].count("\n") == 41
    assert call("GET", f"/api/campaign/{run['id']}/verify")[1]["passed"]
    assert call("POST", f"/api/certify?run={run['id']}&outcome=x&predictors=z")[1]["status"] in ("certified", "not_preserved")


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",), ("a package",)])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    hide = "import sys; sys.modules['xxhash'] = None; " if gone == ("a package",) else ""
    code = hide + "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'op1_chat_formatting' in q, 'pipeline' in q)"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[0]) >= 50 and out[1:] == [str(gone == ("corpus_pipeline.py",)), "False"]


def test_library_does_not_import_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "attestra")):
        if os.path.basename(top) != "llm":
            assert not any("attestra.llm" in open(os.path.join(top, n), encoding="utf-8").read() for n in names if n.endswith(".py"))
