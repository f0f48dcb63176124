"""Residue in many syntaxes and languages is found; texts that show, log or discuss it are not."""

import pytest

from tidewright.llm.residue import find_residue, without_residue

REAL = "The merge of attrs takes 148 s on average, so plan for some delay. Late rows are counted against the period in which they happened."
RESIDUE = [
    *[f"Before touching {p}, read its watermark. {REAL}" for p in ("{{ partition }}", "{{.Values.x}}", "${PARTITION}", "#{field}", "{0}", "{version}", "%NODE%", "%(seq)s", "<OWNER>", "<your start time>", "<column eintragen>", "<first-seq>", "<à compléter : field>", "[insert date here]", "[SEQ]", "[seq をここに記入]", "[TODO: fill in node]", "[[bytes]]", "【nodeを入力】", "__LAST_SEQ__", "________", "@@team@@", "<%= seq %>", "{% VERSION %}", "<<FIELD>>", "$partition$", "(enter version)", "XXXX")],
    "Lorem ipsum dolor sit amet magna velit sed sed labore justo. Magna viverra dolor sit nulla turpis massa tempor dolor.",
    "Runbook: draining t.1\n\nTBD\nMore to follow.\nText goes here.",
    "# Störung\n\nBlindtext zum Prüfen des Layouts. Inhalt folgt in Kürze.",
    "404\n\nThe page you asked for could not be found on this server.\nReference: ee44ae331a68429b",
    '{"status":503,"error":"Access denied","message":"You do not have permission to view this runbook."}',
    "<html><head><title>Access denied</title></head><body><h1>Access denied</h1><p>Your session has expired, sign in again to continue reading.</p></body></html>",
    "PÁGINA NO ENCONTRADA\n\nSU SESIÓN HA CADUCADO, INICIE SESIÓN DE NUEVO.",
    "﻿Erreur 404\nUne erreur inattendue s’est produite, réessayez plus tard. ­",
    "Home\nRunbooks\nSearch\nこの画面を表示するには JavaScript を有効にしてください。\nHelp | Status",
    "<noscript>Please switch on JavaScript to see this dashboard.</noscript>",
    "Text goes here.\n" * 3000,
]
CLEAN = [
    None,
    "",
    " 　\r\n",
    REAL,
    f"{REAL}\n\nOur renderer left `{{{{ service }}}}` in the mails; the texts are clean since.",
    f"{REAL}\n```\nnotify = \"window ${{x}} is late\"   # x is filled\n```",
    f"{REAL}\n```sh\nexport NODE=${{NODE:-n59}}\n",
    'Users saw "Your session has expired" because the clock ran ahead; after correcting it, sign-in worked again.',
    "2026-01-05 08:37:15 [error] gateway: GET /v2/parts/1 -> 404 Not Found (4 ms)\nW 00:21:50 access denied for tenant x on y, request f77a",
    "We dropped the notice that scripts must be allowed, since the viewer now renders on the server.",
    "See [the drain chapter](docs/drain.md) and footnote [12]; section [B] lists the limits. | `a` | array<string> |",
    'The field is written as {"a":{"b":{"seq":1660572}}} and must be parsed, not matched.',
    "<f4> no idea why rt/41860 came back\n<g7> lol, clock drift of 838 ms",
    "Error 404\n\n" + REAL,
]
SCHEMA = "doc_id bigint, text string, path string, tenant string, segs string, title string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, f"runbook/t/{k}.md", "t", "x", "y") for k, t in enumerate(RESIDUE + CLEAN)], SCHEMA).repartition(2)


def test_found_and_kept(docs):
    found = {r.doc_id for r in find_residue(docs).collect()}
    missed = [RESIDUE[k][:80] for k in range(len(RESIDUE)) if k not in found]
    wrong = [CLEAN[k - len(RESIDUE)] for k in found if k >= len(RESIDUE)]
    assert (missed, wrong) == ([], [])
    kept = without_residue(docs)
    assert {r.doc_id for r in kept.collect()} == set(range(len(RESIDUE), len(RESIDUE + CLEAN))) and kept.columns == docs.columns


def test_messages_are_learned_from_the_corpus(spark):
    known, strange = "Text goes here.", "Wombat kiosk resting between errands."
    rows = [(k, f"{known}\n{strange}\n{known}", f"a/{k % 3}/{k}.md", f"h{k % 3}", "", "") for k in range(6)]
    rows += [(10, f"Some title about drains\n{strange}\nText goes here.", "b/x/1.md", "h1", "", "")]
    rows += [(20 + k, f"Notes on the ledger\n{REAL}\nThe gap belongs to the seventh node of that group.\n{known}", "c/x/2.md", "h2", "", "") for k in range(2)]
    ids = {r.doc_id: r.evidence for r in find_residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(ids) == {0, 1, 2, 3, 4, 5, 10} and ids[10] == "learned"


def test_empty_and_nulls(spark, docs):
    assert find_residue(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "TBD", None, None, "", ""), (1, "TBD", None, None, "", ""), (1, "TBD", None, None, "", "")], SCHEMA)
    assert sorted((r.doc_id for r in find_residue(nulls).collect()), key=repr) == [1, 1, None]
    assert without_residue(nulls).count() == 1


def test_long_and_fenced_records(spark):
    error = "Your session has expired, sign in again to continue reading."
    strange = "Wombat kiosk resting between errands."
    frame = ["Home", "Runbooks", "Search", "Help", "Status", "Log in"]
    late = "\n".join([*frame, "Draining the seventh node of the group", *[error] * 6])  # the middle segment is the title
    rows = [(0, late, "a/x/0.md", "h0", "", ""), (1, f"Error 404\n\n{error}\n```\n0x1f 77\n```", "a/x/1.md", "h1", "", "")]
    rows += [(10 + k, "\n".join(["Text goes here."] * 15 + [strange] + ["Text goes here."] * 15), f"a/{k}/x.md", f"h{k}", "", "") for k in range(4)]
    rows += [(20, f"{error}\n```sql\nSELECT origin FROM logs\n```", "b/x/1.md", "h1", "", ""), (21, f"How sign-in failed\n```\n{error}\n```", "b/x/2.md", "h2", "", "")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 1, 10, 11, 12, 13}


def test_messages_are_learned_without_the_lists(spark):
    strange = "Gwall annisgwyl, rhowch gynnig arall arni nes ymlaen."
    rows = [(k, f"Draining number {'abcdefghijkl'[k] * 5}\n{strange}" if k % 3 else strange, f"runbook/host{k % 5}/{k}.md", f"h{k % 5}", "", "") for k in range(12)]
    rows += [(20 + k, f"Gaps of origin {k}\nThe gaps of this origin were filled within minutes.", f"note/host{k % 5}/{k}.md", f"h{k % 5}", "", "") for k in range(12)]
    rows += [(40 + k, f"Some note {k}\nOnly one host repeats this wording.", f"note/host1/{k}.md", "h1", "", "") for k in range(12)]
    ids = {r.doc_id: r.evidence for r in find_residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert ids == {k: "learned" for k in range(12)}


def test_length_code_and_wording_make_no_switch(spark):
    notice = "Please switch on JavaScript to see this dashboard."
    around = lambda k: "\n".join(["Draining the seventh node", *[notice] * k, "Draining the seventh node", *[notice] * k])
    rows = [(0, around(4), "a/x/0.md", "h0", "", ""), (1, around(7), "a/x/1.md", "h1", "", ""), (2, around(700), "a/x/2.md", "h2", "", "")]
    rows += [(3, "Page not found.\n```\n```\nPlease enable JavaScript to continue.", "a/x/3.md", "h0", "", "")]
    real = [
        "We could not reproduce the memory leak on staging, so the owners raised the heap of the sealer instead.",
        "Unable to connect the second replica before the switch had been replaced, we ran on one for a day.",
        "If the problem persists after the drain, raise the seal age and look at the ledger again.",
        "The page you asked for was written by the storage team and lists the limits of each tenant.",
        "Please try again later, said the old runbook, but nobody knew how much later that was.",
    ]
    rows += [(10 + k, text, f"runbook/x/{k}.md", "h1", "", "") for k, text in enumerate(real)]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 1, 2, 3}


def test_stray_ends_are_told_from_content(spark):
    error = "Your session has expired, sign in again to continue reading."
    noise = "Qwfp luy arst neio zxcv"
    rows = [(k, f"{error}\n{noise}", f"a/h{k}/x.md", f"h{k}", "", "") for k in range(2)]
    rows += [(10 + k, f"The gap of {w} was filled.\nAfter {w} had moved, its {w}s were counted twice.\nNobody saw why {w} grew.\n{noise}", f"note/h{k}/{w}.md", f"h{k}", "", "") for k, w in enumerate(["amber", "birch", "cobalt", "dune"])]
    rows += [(20, f"{error}\nIt was the clock of the gateway.", "a/h1/y.md", "h1", "", "")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 1}
