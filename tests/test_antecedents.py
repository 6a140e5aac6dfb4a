"""Evidence in a text, and signals of earlier acts."""

from __future__ import annotations

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from lumbrera.operators import antecedents as A


def test_folded_places():
    text = "  ﬁn  «Año»\n\nX "
    whole, place = A.folded(text)
    assert whole == 'fin "año" x' and [text[p] for p in place][-1] == "X" and len(place) == len(whole)
    assert A.folded("") [0] == "" and A.folded(" \n ")[0] == ""


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=14), st.lists(st.text("ab", min_size=1, max_size=2), min_size=1, max_size=3))
def test_spans_by_brute_force(text, pieces):
    places = [[(i, i + len(p)) for i in range(len(text)) if text.startswith(p, i)] for p in pieces]
    chains = [c for c in product(*places) if all(a[1] <= b[0] for a, b in zip(c[:-1], c[1:], strict=True))]
    want = sorted({(c[0][0], c[-1][1]) for c in chains}) if len(chains) <= A.MOST_PLACES else []
    assert A.spans(text, pieces) == want


TEXT = (
    "Antecedentes de hecho. Mediante resolución de 3 de mayo de 2020 se otorgó autorización administrativa previa al parque Alfa. "
    "Fundamentos de derecho. La ley. RESUELVE: otorgar autorización administrativa de construcción al parque Beta."
)


def test_signals(spark):
    rows = [
        ("early", "Resolución por la que se otorga autorización administrativa de construcción", TEXT, "se otorgó  autorización administrativa PREVIA [...] parque Alfa", "autorizacion_administrativa_previa"),
        ("own", "Resolución", TEXT, "otorgar autorización administrativa de construcción", "autorizacion_administrativa_construccion"),
        ("lost", "Resolución", TEXT, "nunca dicho", "prorroga"), ("title", "Mediante resolución de 3 de mayo de 2020", TEXT, "mediante resolución de 3 de mayo de 2020", "prorroga"), ("null", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, title string, text string, evidence string, action_type string").selectExpr("*", "DATE '2024-01-02' AS day")
    found = {r["k"]: r for r in A.possible_antecedents(df).collect()}
    assert set(found) == {"early"}
    row = found["early"]
    assert row["temporal"] == ["evidence_in_antecedentes", "explicit_earlier_resolution"]
    assert row["contextual"] == ["documentary_section_separation", "evidence_before_operative_block"]
    assert TEXT[row["spans"][0]["start"] : row["spans"][0]["end"]] == "se otorgó autorización administrativa previa al parque Alfa" and row["spans"][0]["section"] == "facts"
