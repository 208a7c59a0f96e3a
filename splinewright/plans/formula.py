"""Wilkinson formulas: `y ~ x + fac + s(u, k=10, bs='cr') + te(v, w) + s(z, by=fac)`."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

SMOOTHS = {"s": "tp", "te": "cr", "ti": "cr"}
OPTIONS = {"m", "max_knots"}


@dataclass(frozen=True)
class SmoothSpec:
    kind: str
    variables: tuple[str, ...]
    bs: str
    k: int = -1
    by: str | None = None
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def label(self) -> str:
        inner = ",".join(self.variables)
        return f"{self.kind}({inner},by={self.by})" if self.by else f"{self.kind}({inner})"


@dataclass(frozen=True)
class ParametricTerm:
    name: str


@dataclass(frozen=True)
class FormulaSpec:
    response: str
    parametric: tuple[ParametricTerm, ...]
    smooths: tuple[SmoothSpec, ...]
    has_intercept: bool = True

    def variables(self) -> list[str]:
        names = [t.name for t in self.parametric]
        for s in self.smooths:
            names += [*s.variables, *([s.by] if s.by else [])]
        return list(dict.fromkeys(names))


def parse_formula(text: str) -> FormulaSpec:
    left, tilde, right = text.partition("~")
    if not tilde:
        raise ValueError(f"Formula has no '~': {text!r}")
    if not left.strip():
        raise ValueError(f"Formula has no response: {text!r}")
    if not right.strip():
        raise ValueError(f"Formula has no right-hand side: {text!r}")
    try:
        tree = ast.parse(right.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"Formula can't be parsed: {text!r}") from e
    terms: list = []
    intercept = _walk(tree, terms, True)
    smooths = [t for t in terms if isinstance(t, SmoothSpec)]
    labels = [s.label for s in smooths]
    if len(set(labels)) < len(labels):
        raise ValueError(f"Smooth terms must differ: {', '.join(labels)}")
    return FormulaSpec(left.strip(), tuple(t for t in terms if isinstance(t, ParametricTerm)), tuple(smooths), intercept)


def _walk(node, terms: list, intercept: bool) -> bool:
    """Adds a sub-expression's terms; returns whether the intercept stays."""
    match node:
        case ast.BinOp(op=ast.Add()):
            return _walk(node.right, terms, _walk(node.left, terms, intercept))
        case ast.BinOp(op=ast.Sub(), right=ast.Constant(value=1)):
            _walk(node.left, terms, intercept)
            return False
        case ast.BinOp():
            raise ValueError(f"Only '+' joins terms, and '- 1' drops the intercept: {ast.unparse(node)}")
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=1)) | ast.Constant(value=0):
            return False
        case ast.Constant(value=1):
            return intercept
        case ast.Constant() | ast.UnaryOp():
            raise ValueError(f"Not a term: {ast.unparse(node)}")
        case ast.Name(id=name):
            terms.append(ParametricTerm(name))
        case ast.Call():
            terms.append(_smooth(node))
        case _:
            raise ValueError(f"Not a term: {ast.unparse(node)}")
    return intercept


def _smooth(node: ast.Call) -> SmoothSpec:
    kind = node.func.id if isinstance(node.func, ast.Name) else ast.unparse(node.func)
    if kind not in SMOOTHS:
        raise ValueError(f"Unknown function '{kind}'. Available: {', '.join(SMOOTHS)}")
    if not node.args:
        raise ValueError(f"{kind}() needs a variable")
    if not all(isinstance(a, ast.Name) for a in node.args):
        raise ValueError(f"{kind}() takes names of variables: {ast.unparse(node)}")
    k, bs, by, extra = -1, SMOOTHS[kind], None, {}
    for kw in node.keywords:
        value = kw.value
        if kw.arg == "by" and isinstance(value, ast.Name):
            by = value.id
            continue
        try:
            found = ast.literal_eval(value)
        except (ValueError, TypeError) as e:
            raise ValueError(f"{kw.arg} of {kind}() must be a literal") from e
        if kw.arg == "k":
            if not isinstance(found, int) or isinstance(found, bool):
                raise ValueError("k must be one integer")
            k = found
        elif kw.arg == "bs":
            if not isinstance(found, str):
                raise ValueError("bs must be a string")
            bs = found.lower()
        elif kw.arg == "by":
            if not isinstance(found, str):
                raise ValueError("by must be a name")
            by = found
        elif kw.arg in OPTIONS:
            extra[kw.arg] = found
        else:
            raise ValueError(f"{kind}() has no option '{kw.arg}'")
    return SmoothSpec(kind, tuple(a.id for a in node.args), bs, k, by, extra)
