"""Small driver-side formatters over aggregated rows: cells, escapes, tables, colours."""

from __future__ import annotations

import math


def mean_cell(mean: float | None, se: float | None, digits: int = 1) -> str:
    if mean is None:
        return "--"
    return f"{mean:.{digits}f}" if se is None else f"{mean:.{digits}f}$_{{\\pm {se:.{digits}f}}}$"


def p_value(p: float | None) -> str:
    if p is None:
        return "--"
    return "<0.001" if p < 0.001 else f"{p:.3f}"


# LaTeX's special characters.
_SPECIAL = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def escape(text: str) -> str:
    return "".join(_SPECIAL.get(c, c) for c in text)


def table(rows: list[dict], columns: list[tuple[str, str]], caption: str = "") -> str:
    """A tabular of rows already aggregated; columns: (name, header)."""
    lines = [r"\begin{tabular}{l" + "r" * (len(columns) - 1) + "}", r"\toprule", " & ".join(h for _, h in columns) + r" \\", r"\midrule"]
    for r in rows:
        lines.append(" & ".join(escape(v) if isinstance(v := r[c], str) and "$" not in v else "--" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for c, _ in columns) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", *([f"% {caption}"] if caption else [])])


def tint(value: float, low: float, high: float) -> float:
    """Where a value lies in a ramp, from 0 to 1."""
    return min(1.0, max(0.0, (value - low) / (high - low))) if high > low else 0.0


def diverge(value: float, anchor: float) -> float:
    """From -1 to 1 around zero; anchor is where a colour is full."""
    return max(-1.0, min(1.0, value / anchor)) if anchor > 0 else 0.0


def rms_anchor(values: list[float]) -> float:
    return math.sqrt(sum(v * v for v in values) / len(values)) if values else 0.0


def dark_text(red: float, green: float, blue: float) -> bool:
    """Whether black text reads better on a colour (components 0 to 1)."""
    return 0.299 * red + 0.587 * green + 0.114 * blue > 0.55


def fit_scale(shown: list[tuple[float, float]], low: float = 0.2, high: float = 30.0, step: float = 0.001) -> float | None:
    """The middle one of the scales that reproduce all shown (value, shade) pairs to two places."""
    n = round((high - low) / step) + 1
    fit = [s for i in range(n) if all(round(max(-1.0, min(1.0, v / (s := low + i * step))), 2) == round(c, 2) for v, c in shown)]
    return round(fit[len(fit) // 2], 3) if fit else None


def unique_short(names: list[str]) -> dict[str, str]:
    """Compact display names; a clash is an error."""
    import re

    out = {}
    for n in names:
        s = n.rsplit("/", 1)[-1]
        for pattern, to in ((r"[-_](instruct|chat|preview|it)\b", ""), (r"(?i)-fp8(-\w+)?$", ""), (r"-\d{4,}$", "")):
            s = re.sub(pattern, to, s)
        out[n] = s
    if len(set(out.values())) != len(out):
        raise ValueError("two names have one short form")
    return out
