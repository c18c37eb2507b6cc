"""The entry point without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_alone(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "stemmata", tmp_path / "stemmata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'quotation_scan' in q and set(o) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_broken_operator_is_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "stemmata", tmp_path / "stemmata", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import stemmata.llm.gone\n")
    if not (tmp_path / "stemmata" / "llm").exists():
        (tmp_path / "stemmata" / "llm").mkdir()
        (tmp_path / "stemmata" / "llm" / "__init__.py").touch()
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as x:\n    assert x.name == 'stemmata.llm.gone'\nelse:\n    raise SystemExit(1)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "stemmata").rglob("*.py"):
        if "llm" not in path.parts:
            assert "stemmata.llm" not in path.read_text(), path
