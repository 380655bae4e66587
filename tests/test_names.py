"""No name of a module is defined twice: the second one would hide the first, tests included."""

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
FILES = [p for top in ("attrisieve", "tests") for p in sorted((ROOT / top).rglob("*.py"))] + sorted(ROOT.glob("*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined_once(path):
    tree = ast.parse(path.read_text())
    for body in [tree.body, *[n.body for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]]:
        defined = Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert [name for name, n in defined.items() if n > 1] == []


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_imports_are_used(path):
    tree = ast.parse(path.read_text())
    imported = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", "") != "__future__" for a in n.names}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    quoted = " ".join(n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str))
    assert sorted(x for x in imported - used if x not in quoted) == []
