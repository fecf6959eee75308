"""Stage tables shared by several queries of one session."""

from __future__ import annotations

import functools

from helioframe.functions.stages import discard, settle

_tables: dict[tuple, object] = {}


def staged(build):
    """Write the result of ``build(spark, sf_dir)`` once per application and input, then read it back.

    ``build`` may return a pair of the result and its only sources, stored tables that go then.
    ``build`` itself stays reachable as ``.build``.
    """

    @functools.wraps(build)
    def table(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, build.__module__, build.__name__)
        if key not in _tables:
            built = build(spark, sf_dir)
            built, spent = built if isinstance(built, tuple) else (built, None)
            _tables[key] = settle(built)
            if spent is not None:
                discard(spent)
        return _tables[key]

    table.build = build
    return table


def reset() -> None:
    """Forget the stage tables, so that the next use builds them again."""
    _tables.clear()
