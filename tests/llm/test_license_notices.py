"""Published notices as they stand in files: wrapped, on one line, behind comment signs."""

import textwrap

import pytest
from pyspark.sql import functions as F

from strom.llm import licenses

LONG = sorted(name for name, text in licenses.NOTICES.items() if len(text) > 100)
FORMS = {
    "one line": lambda t: t,
    "wrapped": lambda t: "\n".join(textwrap.wrap(t, 60)),
    "comment": lambda t: "\n".join(f" * {line}" for line in textwrap.wrap(t, 60)),
    "hash": lambda t: "\r\n".join(f"# {line}" for line in textwrap.wrap(t, 70)),
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(f"{name}|{form}", f"Some words before.\n\n{made(licenses.NOTICES[name])}\n\nWords after, a few of them.") for name in LONG for form, made in FORMS.items()]
    rows += [("none|", "The program is free and the software is provided with a general plan for public use, you can permit persons to whom it is furnished."), ("null|", None)]
    return {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_each_notice_finds_itself(scanned, form):
    for name in LONG:
        found = scanned[f"{name}|{form}"]
        assert found.best_dice == 1.0 and name in found.licenses.split(","), (name, found)


def test_other_words_match_nothing(scanned):
    assert scanned["none|"].n_matches == 0 and scanned["null|"].n_matches == 0


def test_whole_licence_text(spark):
    parts = ["MIT License", "Copyright (c) 2020 Some One", *(licenses.NOTICES[f"MIT-{p}"] for p in ("paragraph", "inclusion", "warranty"))]
    text = "\n\n".join("\n".join(textwrap.wrap(p, 78)) for p in parts)
    found = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string").withColumn("_found", F.lit("clash"))).first()
    assert found.licenses == "MIT-inclusion,MIT-paragraph,MIT-warranty" and found.best_dice == 1.0
