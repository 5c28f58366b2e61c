"""Operators on small tables, with the cases that decided their semantics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lethe.functions.storage import Snapshots
from lethe.operators import audit, catalog, dictionary, loc, payloads, quality, sanitize, tokens
from lethe.sources import readers

def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts):
    return frame(spark, list(enumerate(texts)), "doc_id long, text string")


def naive(text, values):
    """Longest first, no overlaps."""
    taken, out = set(), []
    for v in sorted(values, key=lambda v: -len(v)):
        at = text.find(v)
        while at >= 0:
            if not taken & set(range(at, at + len(v))):
                taken |= set(range(at, at + len(v)))
                out.append((at, at + len(v), v))
            at = text.find(v, at + 1)
    return sorted(out)


@pytest.mark.parametrize(("characters", "passes"), [(1_000_000, 8), (30, 100), (1, 0)])
def test_occurrences_are_a_substring_scan(spark, monkeypatch, characters, passes):
    monkeypatch.setattr(dictionary, "MOST_CHARACTERS", characters)
    monkeypatch.setattr(dictionary, "MOST_PASSES", passes)
    r = random.Random(3)
    texts = ["".join(r.choice("ab cé") for _ in range(r.choice([0, 3, 50, 1003, 2500]))) for _ in range(25)]
    values = {"".join(r.choice("ab cé") for _ in range(r.randint(2, 7))) for _ in range(25)}
    got = dictionary.occurrences(docs(spark, texts), frame(spark, [(v,) for v in values], "value string")).collect()
    want = {(i, k, k + len(v), v) for i, t in enumerate(texts) for v in values for k in range(len(t)) if t.startswith(v, k)}
    assert {(x.doc_id, x.start, x.end, x.value) for x in got} == want and len(got) == len(want)


WAYS = [(1_000_000, 8), (3, 100), (1, 0)]


@pytest.mark.parametrize(("characters", "passes"), WAYS)
def test_lower_case_keeps_places(spark, monkeypatch, characters, passes):
    monkeypatch.setattr(dictionary, "MOST_CHARACTERS", characters)
    monkeypatch.setattr(dictionary, "MOST_PASSES", passes)
    texts = ["\u0130\u0130\u0130 Acme corp", "\u0130acme", "ΟΔΟΣ x", "a\u0130b"]
    got = dictionary.blacklist_hits(docs(spark, texts), frame(spark, [("acme",), ("οδος",), ("a\u0130b",)], "term string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.value) for r in got) == [(0, 4, 8, "Acme"), (2, 0, 4, "ΟΔΟΣ"), (3, 0, 3, "a\u0130b")]


@pytest.mark.parametrize(("characters", "passes"), WAYS)
def test_values_skipped_in_one_text(spark, monkeypatch, characters, passes):
    monkeypatch.setattr(dictionary, "MOST_CHARACTERS", characters)
    monkeypatch.setattr(dictionary, "MOST_PASSES", passes)
    own = frame(spark, [(0, "Jan Jansen, Jan", ["jan jansen"]), (1, "Jan Jansen, Jan", None), (2, None, ["x"]), (3, "", [])], "doc_id long, text string, skip array<string>")
    got = dictionary.known_values(own, frame(spark, [("Jan Jansen",), ("Jan",), (None,)], "value string"), skip_col="skip").collect()
    assert sorted((r.doc_id, r.start, r.value) for r in got) == [(0, 0, "Jan"), (0, 12, "Jan"), (1, 0, "Jan Jansen"), (1, 12, "Jan")]


def test_no_values_and_ids_of_text(spark):
    own = frame(spark, [("a", "Jan"), (None, "Jan")], "doc_id string, text string")
    none = frame(spark, [], "value string")
    assert dictionary.matches(own, none).count() == 0
    assert {r.doc_id for r in dictionary.matches(own, frame(spark, [("Jan",)], "value string")).collect()} == {"a", None}


def test_longest_first(spark):
    texts = ["Jan Jansen and Jan", "[PERSON_1_abcdef] Jan", "none"]
    got = dictionary.matches(docs(spark, texts), frame(spark, [("Jan Jansen",), ("Jan",), ("PERSON",)], "value string")).collect()
    assert sorted((x.doc_id, x.start, x.value) for x in got) == [(0, 0, "Jan Jansen"), (0, 15, "Jan"), (1, 18, "Jan")]
    assert [(s, e, v) for _, s, e, v in sorted(map(tuple, got)) if _ == 0] == naive(texts[0], ["Jan Jansen", "Jan"])


def test_known_values_short_ones_whole(spark):
    got = dictionary.known_values(docs(spark, ["ask Li about Lithium", "x"]), frame(spark, [("Li",), ("x",), (" y ",), ("Lithi",)], "value string"), frame(spark, [("LITHI",)], "value string"))
    assert [(r.start, r.value) for r in got.collect()] == [(4, "Li")]


def test_blacklist(spark):
    got = dictionary.blacklist_hits(docs(spark, ["ACME and acme's, notacme; a.b(c)+ x"]), frame(spark, [("acme",), ("A.B(C)+",)], "term string")).collect()
    assert sorted((r.start, r.value) for r in got) == [(0, "ACME"), (9, "acme"), (26, "a.b(c)+")]


def test_round_trip_and_idempotence(spark):
    texts = ["mail a@b.com and a@b.com, c@d.org", 'token = "abcdefgh1" e@f.gh', "plain", "", "Jan~ ok a@b.com"]
    out, known = sanitize.tokenize(docs(spark, texts))
    rows = {r.doc_id: r for r in out.collect()}
    assert all("@" not in rows[i].sanitized for i in rows) and rows[4].sanitized.startswith("Jan ok [EMAIL_ADDRESS_")
    assert rows[0].sanitized.count(next(t for t, v in rows[0].tokens.items() if v == "a@b.com")) == 2
    back = tokens.restore(out.select("doc_id", F.col("sanitized").alias("text")), known)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t.replace("~", "") for i, t in enumerate(texts)}
    again, table = sanitize.sanitize(out.select("doc_id", F.col("sanitized").alias("text")), known)
    assert table.count() == known.count() and {r.doc_id: r.sanitized for r in again.collect()} == {i: r.sanitized for i, r in rows.items()}


def test_sanitize_uses_known_values(spark):
    known = frame(spark, [("[PERSON_7_abcdef]", "Jan Jansen", "PERSON")], "token string, value string, label string")
    out, table = sanitize.sanitize(docs(spark, ["Jan Jansen a@b.com"]), known)
    r = out.first()
    assert r.sanitized.startswith("[PERSON_7_abcdef] [EMAIL_ADDRESS_1_") and set(r.tokens.values()) == {"Jan Jansen", "a@b.com"}
    assert table.count() == 2


def test_stages(spark):
    d = docs(spark, ["Jan  Jansen works at Acme, code Zeus"])
    ents = frame(spark, [(0, 0, 11, "person"), (0, 21, 25, "organization")], "doc_id long, start int, end int, label string")
    out, _ = sanitize.tokenize(d, entities=ents, custom=frame(spark, [("Zeus",)], "value string"), blacklist=frame(spark, [("acme",)], "term string"))
    s = out.first().sanitized
    assert s.startswith("Jan  [PERSON_1_") and "[BLACKLIST_PERSON_1_" in s and "[SENSITIVE_1_" in s and "Jansen" not in s


def test_chain_unresolved_and_recovery(spark):
    known = frame(spark, [("[A_1_aaaaaa]", "x [B_1_bbbbbb]", "A"), ("[B_1_bbbbbb]", "[C_1_cccccc]!", "B"), ("[C_1_cccccc]", "$1 end", "C")], "token string, value string, label string")
    d = docs(spark, ["say [A_1_aaaaaa] [D_1_dddddd]"])
    assert tokens.restore(d, tokens.chained(known)).first().text == "say x $1 end! [D_1_dddddd]"
    assert [tuple(r) for r in tokens.unresolved(d, known).collect()] == [(0, "[D_1_dddddd]")]
    events = frame(spark, [(1, {"[D_1_dddddd]": "old"}), (2, {"[D_1_dddddd]": "new", "[E_1_eeeeee]": "x"})], "event_id long, tokens_map map<string,string>")
    assert [tuple(r) for r in tokens.recover(tokens.unresolved(d, known), events).collect()] == [("[D_1_dddddd]", "new", "D", "audit_recovery")]
    ok, held = tokens.block_unresolved(d, known)
    assert ok.count() == 0 and held.count() == 1


def test_mint_scopes_and_retention(spark):
    values = frame(spark, [("P", "b"), ("P", "aa"), ("P", "cc"), ("Q", "aa")], "label string, value string")
    first = tokens.mint(values)
    assert sorted((r.label, r.value, r.token.split("_")[1]) for r in first.collect()) == [("P", "aa", "1"), ("P", "cc", "2"), ("Q", "aa", "1")]
    second = tokens.mint(values.unionByName(frame(spark, [("P", "ab")], "label string, value string")), first)
    assert {r.token for r in first.collect()} < {r.token for r in second.collect()} and "[P_3_" in str(second.where("value = 'ab'").first().token)
    other = frame(spark, [("[P_9_ffffff]", "aa", "P")], "token string, value string, label string")
    assert tokens.scoped([other, first], ["value", "label"]).where("value = 'aa' and label = 'P'").first().token == "[P_9_ffffff]"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 31)
    kv = frame(spark, [("t1", "x", old), ("t2", "y", new)], "token string, value string, created_at timestamp")
    al = frame(spark, [("x", old, old), ("y", new, dt.datetime(2024, 7, 1))], "value string, granted_at timestamp, expires_at timestamp")
    k, a = tokens.sweep(kv, al, now(), "days:30")
    assert [r.token for r in k.collect()] == ["t2"] and [r.value for r in a.collect()] == ["y"] and tokens.sweep(kv, al, now(), "permanent")[0].count() == 2
    k, a = tokens.erase(kv, al, "x")
    assert k.count() == 1 and a.count() == 1
    with pytest.raises(ValueError):
        tokens.grant_allowance(al, now(), 2000)


CUSTOMERS = "id int, first_name string, last_name string, email string, phone string, account_id string, notes string"


def scan(spark, rows):
    return catalog.findings(catalog.melt(frame(spark, rows, CUSTOMERS), "customers", "id"), "crm")


def test_catalog_cycle(spark):
    one = (1, "Jan", "Jansen", "jan@example.test", "+31612345678", "CUST-001", "VIP contact")
    two = (2, "Bietje", "Bakker", "b@example.test", None, "CUST-002", "")
    found = scan(spark, [one, two])
    assert {(r.column, r.category) for r in found.collect()} >= {("email", "EMAIL_ADDRESS"), ("phone", "PHONE_NUMBER"), ("first_name", "PERSON"), ("account_id", "IDENTIFIER")}
    entries, refs = catalog.refresh(None, None, found, "crm", "r1", now())
    changed = (1, "Jan", "Jansen", "new@example.test", "+31612345678", "CUST-001", "VIP contact")
    e2, r2 = catalog.refresh(entries, refs, scan(spark, [changed, two]), "crm", "r2", now())
    assert {r.value for r in e2.where("status = 'stale'").collect()} == {"jan@example.test"}
    e3, _ = catalog.refresh(e2, r2, scan(spark, [one, two]), "crm", "r3", now())
    assert {r.value for r in e3.where("status = 'stale'").collect()} == {"new@example.test"}
    audit_rows = frame(spark, [("saw Jan@example.test",), ("other",), (None,)], "detail string")
    e4, r4, f4, a4 = catalog.forget(e3, r2, found, audit_rows, "jan@example.test")
    assert e4.where("status = 'removed' and value is null").count() == 1 and a4.count() == 2 and f4.where("value = 'jan@example.test'").count() == 0
    assert {r.value for r in catalog.report(found, category="EMAIL_ADDRESS").collect()} == {"j***@example.test", "b***@example.test"}
    assert catalog.scan_counters(found).first().total == found.count()
    only = catalog.allowed_entries(entries, refs, ["crm"], ["nothing"])
    assert only.count() == 0 and catalog.allowed_entries(entries, refs, ["crm"]).count() == entries.count()


@pytest.mark.parametrize(
    ("mode", "text", "grant", "want"),
    [
        ("strict", "hello Bietje Bakker", False, "hello [T]"),
        ("balanced", "hello Bietje Bakker", False, "hello Bietje [T]"),
        ("relaxed", "hello Bietje Bakker", False, "hello Bietje Bakker"),
        ("balanced", "Bietje Bakker, b@example.test", False, "[T], b@example.test"),
        ("strict", "hello Bietje Bakker", True, "hello Bietje Bakker"),
    ],
)
def test_policy(spark, mode, text, grant, want):
    entries = frame(spark, [("e", "PERSON", "Bietje Bakker", "[CATALOG_PERSON_abcdef0123]")], "entry_id string, category string, value string, token string")
    grants = frame(spark, [("e", "active", dt.datetime(2030, 1, 1) if grant else dt.datetime(2020, 1, 1))], "entry_id string, status string, expires_at timestamp")
    d = docs(spark, [text])
    decided = catalog.decisions(d, entries, grants, now(), mode)
    assert catalog.enforce(d, decided).first().sanitized.replace("[CATALOG_PERSON_abcdef0123]", "[T]") == want
    assert catalog.enforcement_audit(decided).first().matches == 1


def test_review(spark):
    found = scan(spark, [(1, "Jan", "J", None, None, None, None)])
    key = found.where("column = 'first_name'").select("source", "dataset", "column", "row_ref").withColumn("decision", F.lit("reject"))
    after, log = catalog.review(found, key, "me", now())
    assert after.where("status = 'rejected'").count() == 1 and log.count() == 1


def test_usage_shapes(spark):
    rows = frame(spark, [('{"input_tokens":10,"output_tokens":20,"cache_read_input_tokens":1000}',), ('{"prompt_tokens":5,"completion_tokens":6}',), ('{"input_tokens":0}',)], "u string")
    got = [r.n for r in rows.select(audit.normalized_usage(F.col("u")).alias("n")).collect()]
    assert tuple(got[0]) == (10, 20, 0, 1000) and tuple(got[1]) == (5, 6, 0, 0) and got[2] is None
    m = frame(spark, [('{"type":"message_delta","delta":{},"usage":{"output_tokens":1}}',), ('{"type":"message_delta","delta":{"stop_reason":"end"},"usage":{"output_tokens":2}}',), ('{"usage":{"output_tokens":3}}',)], "m string")
    assert [r.u for r in m.select(audit.admitted_usage(F.col("m")).alias("u")).collect()] == [None, '{"output_tokens":2}', '{"output_tokens":3}']


@pytest.mark.parametrize("rule", ["floor", "capped", "nearest"])
def test_percentiles(spark, rule):
    r = random.Random(rule)
    rows = [(g, float(r.choice([-5, 0, 0.5, 3, 3, 100, 1e6]) * (1 + i % 7))) for g in "ab" for i in range(r.randint(1, 60))]
    got = {x.g: x for x in audit.percentiles(frame(spark, rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}, rule).collect()}
    for g in "ab":
        v = sorted(x for k, x in rows if k == g)
        n = len(v)
        at = lambda q: {"floor": int(n * q), "capped": min(n - 1, int(n * q)), "nearest": max(0, min(n - 1, int(n * q) - 1))}[rule]  # noqa: B023, E731
        assert (got[g].p50, got[g].p95) == (v[at(0.5)], v[at(0.95)])


def test_loc(spark):
    files = frame(spark, [("a/x.py", "# c\n\nx = 1\n"), ("b/Makefile", "all:\n\t#c\n"), ("c/y.bin", "zz")], "path string, text string")
    got = {r.language: tuple(r)[1:] for r in loc.loc_summary(files).collect()}
    assert got == {"Python": (1, 3, 1, 1, 1), "Make": (1, 2, 0, 1, 1), "TOTAL": (2, 5, 1, 2, 2)}
    patch = "--- a/x.py\n+++ b/x.py\n@@\n+one\n+two\n-old\n same\n*** Update File: y.js\n-a\n"
    assert sorted(map(tuple, loc.patch_lines(frame(spark, [(1, patch)], "id int, patch string")).collect())) == [(1, "x.py", 2, 1), (1, "y.js", 0, 1)]
    payload = '{"content":[{"type":"tool_use","id":"t","name":"MultiEdit","input":{"file_path":"z.py","edits":[{"old_string":"a","new_string":"a\\nb"},{"old_string":"c\\nd","new_string":""}]}}]}'
    assert tuple(loc.write_events(frame(spark, [(1, payload)], "id int, payload string")).first()) == (1, "t", "z.py", 1, 2, -1, 2)
    uses = frame(spark, [("s", "1", "/a/b.py"), ("s", "2", "/c/d.py"), ("s", "3", "/e/f.py")], "session_id string, id string, path string")
    results = frame(spark, [("s", "1", None), ("s", "x", "d.py")], "session_id string, tool_use_id string, path string")
    assert sorted((r.id, r.found_by) for r in loc.correlate_writes(uses, results).collect()) == [("1", "id"), ("2", "path")]


def test_payloads(spark):
    p = '{"model":"m","system":"be a@b.com","messages":[{"role":"user","content":[{"type":"text","text":"hi c@d.org"}]},{"role":"tool","content":"x","id":"content"}],"n":1}'
    texts = payloads.text_paths(frame(spark, [(1, p), (2, "no json")], "id int, payload string"))
    assert sorted((r.path, r.text) for r in texts.collect()) == [("$.messages[0].content[0].text", "hi c@d.org"), ("$.messages[0].content[0].type", "text")][:1] + [("$.messages[1].content", "x")]
    assert sorted((r.part, r.text) for r in payloads.chat_texts(frame(spark, [(1, p)], "id int, payload string")).collect()) == [("block", "hi c@d.org"), ("content", "x"), ("system", "be a@b.com")]
    out = payloads.sanitize_payloads(frame(spark, [(1, p)], "id int, payload string"), lambda d: sanitize.tokenize(d)[0]).first().payload
    assert "c@d.org" not in out and "[EMAIL_ADDRESS_1_" in out
    chunk = '{"choices":[{"index":0,"delta":{"tool_calls":[{"index":1,"function":{"arguments":"[A"}}]}}]}'
    assert tuple(payloads.stream_pieces(frame(spark, [("s", 3, chunk)], "stream_id string, seq long, data string")).first()) == ("s", "call:0:1", 3, "[A", False)


def test_request_texts_that_begin_like_lists(spark):
    texts = lambda f, p: sorted((r.part, r.place, r.text) for r in f(frame(spark, [(1, p)], "id int, payload string")).collect())
    p = '{"messages":[{"content":"[A_1] x"},{"content":[]},{"content":[{"type":"text","text":"[y"},{"type":"image"},7]},{"content":null},{"role":"u"},{"content":"cut \\ud83d"}],"system":["z",{"type":"text","text":"s"}]}'
    assert texts(payloads.chat_texts, p) == [("block", 2, "[y"), ("content", 0, "[A_1] x"), ("content", 5, "cut ?"), ("system", -1, "s")]
    assert texts(payloads.chat_texts, '{"system":"[be] kind"}') == [("system", -1, "[be] kind")]
    assert texts(payloads.response_texts, '{"input":"[A_1] x"}') == [("input", -1, "[A_1] x")]
    p = '{"input":[{"content":"[a"},{"content":[{"text":"b"}],"summary":[{"type":"t","text":"c"}]},{"output":"[d]"},{"text":"e"}],"instructions":"f"}'
    assert texts(payloads.response_texts, p) == [("input", 0, "[a"), ("input", 1, "b"), ("input", 1, "c"), ("input", 2, "[d]"), ("input", 3, "e"), ("instructions", -1, "f")]
    for broken in (None, "", "x", "[]", "{}", '{"messages":"no","input":5}'):
        assert texts(payloads.chat_texts, broken) == [] and {x[2] for x in texts(payloads.response_texts, broken)} <= {"5"}


def test_rank_longest(spark):
    values = [None, "", "b", "a", "a", "ccc", "é\U0001f600"] + [f"v{i:03d}" for i in range(300)]
    got = {r.value: r.rank for r in dictionary.rank_longest(frame(spark, [(v,) for v in values], "value string").repartition(3)).collect()}
    want = sorted({v for v in values if v is not None}, key=lambda v: (-len(v), v.encode()))
    assert got == {v: i + 1 for i, v in enumerate(want)}
    assert dictionary.rank_longest(frame(spark, [], "value string")).count() == 0


def test_payloads_by_place(spark):
    upper = lambda d: d.withColumn("sanitized", F.upper("text"))
    one = lambda p: payloads.sanitize_payloads(frame(spark, [(1, p)], "id int, payload string"), upper).first().payload
    assert one('{"bob":1.50,"id":"bob","content":"bob"}') == '{"bob":1.50,"id":"bob","content":"BOB"}'
    deep = '{"content":' + "[" * 40 + '"bob", {"x": "bob", "text" : "a\\n\\"b\\u00e9"}' + "]" * 40 + "}"
    assert one(deep) == deep.replace('["bob"', '["BOB"').replace('"a\\n\\"b\\u00e9"', '"A\\n\\"BÉ"')
    very = '{"content":' + "[" * 3000 + '"bob"' + "]" * 3000 + "}"
    assert one(very) == very.replace("bob", "BOB")
    assert one("no json") == "no json" and one('{"content":""}') == '{"content":""}'
    assert [x[:2] for x in payloads.strings('{"a":[{"text":"x"},"y"],"text":{"z":"w"},"e":[],"f":{}, "g":"v"}')] == [("$.a[0].text", "text"), ("$.a[1]", "a"), ("$.text.z", "z"), ("$.g", "g")]


def test_whole_composition(spark):
    known = frame(spark, [("[PERSON_1_abcdef]", "Jan Jansen", "PERSON"), ("[PERSON_2_abcdef]", "Piet", "PERSON")], "token string, value string, label string")
    entries = frame(spark, [("e1", "ACC-77", "IDENTIFIER", "[CATALOG_IDENTIFIER_0123456789]")], "entry_id string, value string, category string, token string")
    ips = lambda d: d.select("doc_id", F.expr("instr(text, '10.0.0.1') - 1").alias("start"), F.expr("instr(text, '10.0.0.1') + 7").alias("end"), F.lit("ip address").alias("label")).where("start >= 0")
    own = docs(spark, ["Jan Jansen~ has ACC-77 and a@b.com", "Jan Jansen has ACC-77 at 10.0.0.1", "Piet"])
    out, table = sanitize.sanitize(own, known, frame(spark, [("PIET",)], "value string"), entries=entries, verifiers=[ips])
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].sanitized.startswith("Jan Jansen has [CATALOG_IDENTIFIER_0123456789] and [EMAIL_ADDRESS_1_")
    assert got[1].sanitized.startswith("[PERSON_1_abcdef] has [CATALOG_IDENTIFIER_0123456789] at [VERIFIED_IP_ADDRESS_1_") and got[2].sanitized == "Piet"
    assert set(got[1].tokens.values()) == {"Jan Jansen", "ACC-77", "10.0.0.1"} and table.count() == 4
    assert {r.value for r in sanitize.escape_grants(own, now(), 5).collect()} == {"jansen", "jan", "jan jansen"}


def test_quality(spark):
    rows = frame(spark, [("c", ["A@b.c", "x"], ["a@B.c", "y"]), ("c", [], []), ("d", ["z"], [])], "config string, expected array<string>, detected array<string>")
    got = {r.config: (r.tp, r.fp, r.fn, r.f1) for r in quality.summary(quality.scored(rows)).collect()}
    assert got == {"c": (1, 1, 1, 0.5), "d": (0, 0, 1, 0.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\nOne # x\n\nTwo\n")
    (tmp_path / "b.txt").write_text("Two\nThree\n")
    assert sorted(map(tuple, readers.term_list(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect())) == [("One", 0), ("Three", 1), ("Two", 0)]
    (tmp_path / "c.jsonl").write_text('# c\n\n{"text":"t","expected":["e"]}\n')
    assert readers.labelled_corpus(spark, str(tmp_path / "c.jsonl")).first().expected == ["e"]
    (tmp_path / "d.jsonl").write_text('{"text":"t"}\n')
    with pytest.raises(Exception, match="labelled corpus"):
        readers.labelled_corpus(spark, str(tmp_path / "d.jsonl")).collect()
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "src/b.py").write_bytes(b"x\0y")
    (tmp_path / "src/node_modules/c.py").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.source_files(spark, str(tmp_path / "src")).collect()] == ["a.py"]
    lines = frame(spark, [("s", 0, 'data: {"a":1}'), ("s", 1, ": ping"), ("s", 2, "data: [DONE]")], "stream_id string, seq long, line string")
    assert [(r.data, r.is_end, r.other) for r in readers.response_chunks(lines).orderBy("seq").collect()] == [('{"a":1}', False, None), (None, False, ": ping"), (None, True, None)]
    spark.dataSource.register(readers.paged_source("pages_of_test", "id int, name string", lambda page: [(10 * page + i, f"n{i}") for i in range(3)]))
    assert spark.read.format("pages_of_test").option("pages", "4").option("each", "2").load().count() == 12
    assert {(r.field, r.pii) for r in readers.fields({"t": frame(spark, [], "email string, c_name string, id int, city string, z int")}).collect()} == {("email", "email"), ("c_name", "person"), ("id", "identifier"), ("city", "address"), ("z", "")}


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.generation() == 0 and s.commit(spark.range(2)) == 1 and s.commit(spark.range(5)) == 2
    assert s.read().count() == 5 and s.read(1).count() == 2


def test_reuse(spark):
    d = docs(spark, ["a", "a", "b"])
    texts, _ = sanitize.distinct_texts(d)
    assert texts.count() == 2
    results = texts.where("text = 'a'").select("text_hash", F.lit("cfg").alias("config_hash"), F.lit(False).alias("degraded"), F.lit("A").alias("sanitized"))
    done, todo = sanitize.reused(d, results, "cfg")
    assert done.count() == 2 and [r.text for r in todo.collect()] == ["b"]
    assert sanitize.reused(d, results.withColumn("degraded", F.lit(True)), "cfg")[1].count() == 2


def test_span_patches(spark):
    rows = frame(spark, [(1, "é Jan and Jan!", "é [P_1_abcdef] and [P_1_abcdef]!", {"[P_1_abcdef]": "Jan"}), (2, "x Jan", "y [P_1_abcdef]", {"[P_1_abcdef]": "Jan"}), (3, "same", "same", {})], "doc_id int, before string, after string, tokens map<string,string>")
    got = {r.doc_id: r.patch for r in sanitize.span_patches(rows).collect()}
    assert [(s.start, s.end, s.value) for s in got[1]] == [(2, 5, "Jan"), (10, 13, "Jan")] and got[2] is None and got[3] == []
    ents = frame(spark, [(0, "GivenName"), (0, "other")], "doc_id int, label string")
    assert [r.label for r in sanitize.mapped_labels(ents, {"givenname": "PERSON"}).collect()] == ["PERSON"]
