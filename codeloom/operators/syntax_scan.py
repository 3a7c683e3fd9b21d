"""The Python row code of the engine: one flat row per syntax node of interest.

Kept free of package imports: the functions travel to the workers by value, so
a cluster needs nothing installed for them.
"""

from __future__ import annotations

import ast
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle


def _dotted(node) -> str | None:
    """``a`` or ``a.b``; deeper chains keep their last part."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{node.value.id}.{node.attr}" if isinstance(node.value, ast.Name) else node.attr
    return None


# What a syntax node contributes to the table, one function for each kind: name,
# detail, names, n, flag, flag2, doc, in the order of ``_ARROW``.


def _class(node):
    return (node.name, ",".join([d for d in map(_dotted, node.decorator_list) if d]),
            [b for b in map(_dotted, node.bases) if b], len(node.bases), None, None, ast.get_docstring(node))


def _function(node):
    marks = []
    for d in node.decorator_list:
        called = isinstance(d, ast.Call) and isinstance(d.func, ast.Name)
        marks.append(f"{d.func.id}()" if called else _dotted(d))
    args = node.args.args
    hints = [f"{a.arg}:{h}" for a in args if a.annotation is not None and (h := _hint(a.annotation))]
    detail = "|".join([",".join([m for m in marks if m]), _hint(node.returns) or "", ",".join(hints)])
    return (node.name, detail, [a.arg for a in args], len(node.args.defaults), bool(node.decorator_list), None, ast.get_docstring(node))


def _if(node):
    test = node.test
    return (None, type(test).__name__, None, None, bool(node.orelse), isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not), None)


def _loop(node):
    return (None, None, None, None, bool(node.orelse), None, None)


def _try(node):
    return (None, None, None, len(node.handlers), bool(node.finalbody), bool(node.orelse), None)


def _handler(node):
    handled = len(node.body) > 1 or not isinstance(node.body[0], ast.Pass)
    return (_dotted(node.type) or "Exception", None, None, None, handled, None, None)


def _bool_op(node):
    return (None, None, None, len(node.values) - 1, None, None, None)


def _bin_op(node):
    return (type(node.op).__name__, None, None, None, None, None, None)


def _assign(node):
    targets = node.targets
    return (",".join([t.id for t in targets if isinstance(t, ast.Name)]),
            ",".join([t.attr for t in targets if isinstance(t, ast.Attribute)]),
            [t for t in map(_dotted, targets) if t], None, isinstance(node.value, (ast.BinOp, ast.Call)), None, None)


def _call(node):
    func = node.func
    n = len(node.args) + len(node.keywords)
    if isinstance(func, ast.Name):
        return (func.id, "function_call", None, n, None, None, None)
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
        return (_dotted(func), "method_call", None, n, None, None, None)
    return (None, None, None, n, None, None, None)


def _return(node):
    return (None, _returned(node.value), None, None, node.value is not None, None, None)


def _import(node):
    return (None, None, [a.name for a in node.names], None, None, None, None)


def _import_from(node):
    return (None, None, [node.module] if node.module else [], None, None, None, None)


def _hint(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return str(node.value) if isinstance(node, ast.Constant) else None


def _returned(value) -> str:
    if isinstance(value, ast.Constant):
        return f"{type(value.value).__name__}|constant: {value.value}"
    if isinstance(value, ast.Name):
        return f"variable|variable: {value.id}"
    if isinstance(value, ast.Dict):
        return "dict|dictionary"
    return "list|list" if isinstance(value, ast.List) else "None|void"


#: Values that hold no facts: plain ones, and nodes without facts of their own or below.
_BARE = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
_LEAVES = frozenset([type(None), str, int, bool, ast.Name, ast.Constant, ast.Pass, ast.alias, *(t for b in _BARE for t in b.__subclasses__())])
#: Nodes with facts.
_KINDS = {
    ast.ClassDef: _class, ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.If: _if, ast.For: _loop,
    ast.While: _loop, ast.Try: _try, ast.ExceptHandler: _handler, ast.BoolOp: _bool_op, ast.BinOp: _bin_op,
    ast.Assign: _assign, ast.Call: _call, ast.Return: _return, ast.Import: _import, ast.ImportFrom: _import_from,
}


def _facts(node) -> tuple:
    return _KINDS[type(node)](node)


#: Fields that hold values, operators or leaves in every node that has them.
_PLAIN = frozenset(
    "id ctx attr arg op ops type_comment module names level kind conversion is_async simple type_ignores rest kwd_attrs asname".split()
)
#: By kind of node: its name, whether it has facts, and the fields that may lead to more of them.
_SHAPES: dict[type, tuple] = {}


def _shape(kind: type) -> tuple:
    _SHAPES[kind] = found = (kind.__name__, kind in _KINDS, tuple(f for f in kind._fields if f not in _PLAIN))
    return found


def _walk(path: str, text: str, out: list[tuple]) -> None:
    """Appends the rows of a file, with the columns of ``_ARROW`` in order."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        # no entities, but a row, so that such files can be counted
        out.append((path, 0, -1, -1, [], "Unparsed", 1, 1, type(e).__name__, *(None,) * 7))
        return
    lines = text.split("\n")
    shapes, leaves, function, of_class = _SHAPES, _LEAVES, ast.FunctionDef, ast.ClassDef
    # (node, parent row, class row when a direct member, enclosing functions)
    todo, count = [(tree, -1, -1, [])], 0
    push, pop = todo.append, todo.pop
    while todo:
        node, me, owner, scopes = pop()
        kind = type(node)
        name, holds, fields = shapes.get(kind) or _shape(kind)
        if holds:
            parent, me, source = me, count, None
            count += 1
            if kind is function:
                scopes = scopes + [me]
                source = "\n".join(lines[node.lineno - 1 : node.end_lineno]).strip()
            out.append((path, me, parent, owner, scopes, name, node.lineno, node.end_lineno, *_facts(node), source))
        for field in fields:
            value = getattr(node, field, None)
            if type(value) is list:
                member = me if kind is of_class and field == "body" else -1
                for child in value:
                    if type(child) not in leaves:
                        push((child, me, member, scopes))
            elif type(value) not in leaves:
                push((value, me, -1, scopes))


_ARROW = pa.schema(
    [("file_path", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("class_node", pa.int32()),
     ("scopes", pa.list_(pa.int32())), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()),
     ("name", pa.string()), ("detail", pa.string()), ("names", pa.list_(pa.string())), ("n", pa.int32()),
     ("flag", pa.bool_()), ("flag2", pa.bool_()), ("doc", pa.string()), ("source", pa.string())]
)
_FLUSH = 20000  # rows per emitted batch, bounds a worker's memory


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    collected = gc.isenabled()
    gc.disable()  # syntax trees hold no cycles, and looking for some takes a part of every parse
    try:
        for batch in batches:
            for path, text in zip(batch.column("file_path"), batch.column("text")):
                _walk(path.as_py(), text.as_py(), rows)
                if len(rows) >= _FLUSH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)
    finally:
        if collected:
            gc.enable()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
