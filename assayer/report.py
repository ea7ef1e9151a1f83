"""Reports over small aggregates: the numbers are DataFrames, the pages are plain HTML or Markdown made on the driver."""

from __future__ import annotations

import html
from collections.abc import Iterable, Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page shows of a table; it says how many there are in all.
SHOWN = 200


def shown(value: Any) -> str:
    """Whole numbers without decimals, others with up to six; nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return str(round(value)) if abs(value - round(value)) < 1e-9 else f"{value:.6f}".rstrip("0").rstrip(".")


def table(df: DataFrame, most: int = SHOWN) -> str:
    rows = df.limit(most + 1).collect()
    more = f"<p>The first {most} rows of {df.count()}.</p>" if len(rows) > most else ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def bars(values: Mapping[str, float]) -> str:
    """A bar for each value, scaled to the largest."""
    top = max([*values.values(), 0.0]) or 1.0
    rows = "".join(f'<text x="0" y="{22 * i + 14}">{html.escape(k)}</text><rect x="220" y="{22 * i + 3}" width="{360 * max(v, 0.0) / top:.1f}" height="14"/><text x="590" y="{22 * i + 14}">{shown(v)}</text>' for i, (k, v) in enumerate(values.items()))
    return f'<svg width="680" height="{22 * max(1, len(values))}" font-size="12" font-family="sans-serif" fill="#345">{rows}</svg>'


def page(title: str, sections: Iterable[tuple[str, str]], when: datetime | None = None) -> str:
    at = (when or datetime.now(UTC)).strftime("%Y-%m-%d %H:%M UTC")
    body = "".join(f"<section><h2>{html.escape(h)}</h2>{b}</section>" for h, b in sections)
    style = "body{font-family:sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.2em .5em;text-align:left}"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p>{at}</p>{body}</body></html>\n'


def interpretation(means: Mapping[str, float], n_results: int) -> list[str]:
    """What the numbers say, by rule; for when no model comments on them."""
    if not means:
        return ["No scores were made, so nothing can be said about quality."]
    ordered = sorted(means.items(), key=lambda kv: (-kv[1], kv[0]))
    out = [f"{len(means)} metrics over {n_results} results.", f"The best is {ordered[0][0]} at {shown(ordered[0][1])}."]
    if len(ordered) > 1:
        out.append(f"The weakest is {ordered[-1][0]} at {shown(ordered[-1][1])}.")
    if n_results < 5:
        out.append("So few results show that the parts fit together, not how good they are.")
    return out


def evaluation_report(scores: DataFrame, results: int, alerts: DataFrame | None = None) -> str:
    from assayer.operators.scores import by_metric

    means = {r["metric_name"]: r["mean_value"] for r in by_metric(scores).orderBy("metric_name").collect()}
    sections = [("Summary", "".join(f"<p>{html.escape(x)}</p>" for x in interpretation(means, results))), ("Metrics", bars(means)), ("Scores", table(scores.orderBy("sample_id", "metric_name")))]
    if alerts is not None:
        sections.insert(1, ("Alerts", table(alerts)))
    return page("Evaluation", sections)


def assertion_report(questions: DataFrame, rows: DataFrame) -> str:
    """questions: (claim_count, assertion_count)."""
    from assayer.operators.scores import assertion_summary, claim_coverage

    return page("Assertions", [("Coverage", table(claim_coverage(questions))), ("Summary", table(assertion_summary(rows).orderBy("level", "question_id", "assertion")))])


def retrieval_report(summary: DataFrame, assessments: DataFrame | None = None) -> str:
    sections = [("Retrieval metrics", table(summary))]
    if assessments is not None:
        sections.append(("Assessments", table(assessments.groupBy("kind").agg(F.count(F.lit(1)).alias("assessments"), F.count_distinct("question_id").alias("questions")))))
    return page("Retrieval", sections)


def pipeline_report(sections: Mapping[str, DataFrame]) -> str:
    """Steps of several summaries (step, exit_code, log), with what passed and failed of each."""
    from assayer.operators.scores import tally

    return page("Pipeline", [(name, table(tally(steps)) + table(steps)) for name, steps in sections.items()])


def progress_markdown(tests: Sequence[Mapping[str, Any]]) -> str:
    """A Markdown table of tests (node, status, last_success_at), by node."""
    lines = ["| test | status | last success |", "| --- | --- | --- |"]
    lines += [f"| {t['node']} | {t['status']} | {t.get('last_success_at') or '-'} |" for t in sorted(tests, key=lambda t: str(t["node"]))]
    passed = sum(t["status"] == "passed" for t in tests)
    return f"# Test progress\n\n{passed} of {len(tests)} passed.\n\n" + "\n".join(lines) + "\n"
