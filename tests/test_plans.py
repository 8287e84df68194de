"""Physical-plan properties the scale design depends on."""

import contextlib
import io
import re

from qualis import fixtures
from qualis.operators.stats import head_values
from qualis.operators import fill, profile, summary
from qualis.operators.vf import column_value_summary

from .conftest import SF_SMALL


def _formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _exchange_widths(plan: str) -> list[int]:
    """Number of input columns of every Exchange in a formatted plan."""
    widths = []
    for block in plan.split("\n\n"):
        if re.match(r"\(\d+\) Exchange", block.strip()):
            m = re.search(r"Input \[(\d+)\]", block)
            if m:
                widths.append(int(m.group(1)))
    return widths


def test_interpolation_shuffles_rows_once(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_lineitem")
    widths = _exchange_widths(_formatted(fill.interpolate(df, ["l_quantity"], "rid")))
    wide = [w for w in widths if w >= len(df.columns)]
    assert len(wide) == 1, widths


def test_forward_fill_shuffles_rows_once(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_lineitem")
    widths = _exchange_widths(_formatted(fill.forward_fill(df, ["l_quantity", "l_tax"], "rid")))
    assert len([w for w in widths if w >= len(df.columns)]) == 1, widths


def test_head_values_limit_before_shuffle(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_events")
    plan = _formatted(head_values(df, ["event_type", "mixed"], "rid", 30))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_text_value_summary_has_no_join(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_events")
    plan = _formatted(column_value_summary(df, ["event_type", "mixed"], case_of_text=True))
    assert "Join" not in plan


def test_preview_is_a_per_task_top_n(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_events")
    assert "TakeOrderedAndProject" in _formatted(profile.preview(df, "rid", 50))


def test_top_categories_is_a_per_task_top_k(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_events")
    assert "TakeOrderedAndProject" in _formatted(summary.top_categories(df, "event_type"))
