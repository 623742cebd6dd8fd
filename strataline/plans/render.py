"""Reports as text, put together on the driver from the few rows of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def metrics(rolled: Row) -> str:
    """One line for each metric of a roll-up."""
    return "\n".join(f"{name:24} {value:.4f}" if isinstance(value, float) else f"{name:24} {value}" for name, value in rolled.asDict().items() if value is not None)


def snapshot(diff: DataFrame) -> str:
    """The comparison with a baseline, metrics in order of name (as many rows as metrics)."""
    show = lambda x: "-" if x is None else f"{x:.4f}"
    rows = diff.orderBy("metric").collect()
    return "\n".join(f"{r.status:10} {r.metric:24} {show(r.baseline)} -> {show(r.current)}" for r in rows)


def answer(r: Row) -> str:
    if r.abstained:
        return f"No answer: {r.abstain_reason}"
    return f"{r.answer}\n(confidence {r.confidence:.2f}" + (f", groundedness {r.groundedness:.2f})" if getattr(r, "groundedness", None) is not None else ")")


def difference(r: Row) -> str:
    """One section: what was added, removed and changed."""
    lines = [f"Item {r.item_number} {r.section_title} ({r.label_a} -> {r.label_b}), similarity {r.similarity:.2f}"]
    lines += [f"  + {x}" for x in r.added] + [f"  - {x}" for x in r.removed] + [f"  ~ {c.old_text}\n    {c.new_text}" for c in r.changed]
    return "\n".join(lines)
