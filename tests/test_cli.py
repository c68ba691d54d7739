"""The command-line full build (separate process: it owns and stops its session)."""

import json
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_full_build():
    out = tempfile.mkdtemp(prefix="deliverix-cli-")
    proc = subprocess.run(
        [sys.executable, "-m", "deliverix", "--testdata", "/root/testdata/sf0.001", "--out", out,
         "--min-clean-rows", "100", "--master", "local[2]"],
        cwd=ROOT, capture_output=True, text=True, timeout=900)
    assert proc.returncode == 0, proc.stderr[-2000:]
    manifest = json.loads(proc.stdout.strip().splitlines()[-1])["exported"]
    assert manifest["kpi_summary"] == 28 and manifest["otdr"] > 0
    assert os.path.isdir(os.path.join(out, "kpi", "schema_validation"))

