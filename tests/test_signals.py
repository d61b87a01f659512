"""Content signals."""

from __future__ import annotations

import pytest

from sitelens.operators import signals


def told(spark, body):
    rows = signals.signals(spark.createDataFrame([(0, body)], "robots_id int, body string")).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize(
    ("body", "declared", "unknown"),
    [
        ("Content-Signal: search=yes,ai-train=no,use=reference\n", {"search": "yes", "ai-train": "no", "use": "reference"}, []),
        ("content-signal:  search = YES , ai-retrieval=no \n", {"search": "yes", "ai-retrieval": "no"}, []),
        ("Content-Signal: colour=blue, search=yes, shape=round, colour=red\n", {"search": "yes"}, ["colour", "shape"]),
        ("Content-Signal: search=yes\nContent-Signal: search=no\n", {"search": "no"}, []),
        ("Content-Signal: search, =x, ai-train=no\n", {"ai-train": "no"}, []),
    ],
)
def test_declared(spark, body, declared, unknown):
    got = told(spark, body)
    assert (got["declared"], got["unknown_keys"], got["present"], got["boilerplate_only"]) == (declared, unknown, True, False)


def test_terms_alone_and_nothing(spark):
    got = told(spark, "# Content signals: any content-signal below grants ...\nUser-agent: *\n")
    assert got["boilerplate_only"] and not got["present"] and got["summary"] == "The terms are published, but nothing is declared."
    assert told(spark, "User-agent: *\n") is None
    assert told(spark, None) is None


def test_summary(spark):
    assert told(spark, "Content-Signal: search=yes, ai-input=yes, ai-train=no\n")["summary"] == "The site allows use as input of an answer and showing up in AI search, and refuses training of models."
    assert told(spark, "Content-Signal: use=reference\n")["summary"] == "A declaration without a key we know."
