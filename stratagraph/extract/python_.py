"""Python, by the interpreter's own parser."""

from __future__ import annotations

import ast
import warnings

from .records import Emitter

METHOD = "python-ast"


def _signature(node) -> tuple[str, list[str]]:
    a = node.args
    names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]  # *args and **kwargs are no parameters here
    return f"def {node.name}({ast.unparse(a)})", names


def extract(path: str, text: str) -> Emitter:
    out = Emitter(path, METHOD)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.ambiguity(path, "SourceFile", getattr(e, "lineno", None) or 1, "syntax error, nothing extracted")
        return out
    scopes: list[tuple[str, int, int]] = []  # in breadth-first order; the last that holds a line is its innermost
    owner = lambda line: next((u for u, a, z in reversed(scopes) if a <= line <= z), out.file_uid)
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first, last = node.lineno, node.end_lineno or node.lineno
            source, doc = ast.get_source_segment(text, node) or "", ast.get_docstring(node) or ""
            parent = owner(first)
            if isinstance(node, ast.ClassDef):
                uid = out.entity("Class", node.name, first, last, "definition", doc, {"language": "python"}, source, f"class {node.name}")
                for base in node.bases:
                    if isinstance(base, ast.Name):
                        out.pending("extends", uid, base.id, first)
            else:
                signature, names = _signature(node)
                returns = ast.unparse(node.returns) if node.returns else ""
                uid = out.entity("Function", node.name, first, last, "definition", doc, {"language": "python"}, source, signature, returns, names)
                for call in ast.walk(node):
                    if isinstance(call, ast.Call) and isinstance(call.func, ast.Name):
                        out.pending("call", uid, call.func.id, call.lineno)
            out.declare(parent, uid, first)
            scopes.append((uid, first, last))
        elif isinstance(node, ast.Assign | ast.AnnAssign) and not scopes:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    uid = out.entity("Variable", target.id, node.lineno, node.end_lineno or node.lineno, "definition", "Module-level assignment", {"language": "python"}, ast.get_source_segment(text, node) or "")
                    out.declare(out.file_uid, uid, node.lineno)
        elif isinstance(node, ast.Import | ast.ImportFrom):
            for alias in node.names:
                out.pending("import", out.file_uid, alias.name, node.lineno)
    return out
