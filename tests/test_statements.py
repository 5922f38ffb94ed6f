"""Parsing of small own documents."""

import base64
import random
import xml.etree.ElementTree as ET
import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

import pytest

from ledgerline.sources import statements as st
import pytest

from ledgerline.streaming import operators as so
from ledgerline.streaming import stateful as sf

SMALL = """<SprFinJednostkaMalaWTysiacach xmlns="urn:x"><Naglowek><NazwaFirmy> Test </NazwaFirmy><P_1E>123</P_1E></Naglowek><P_3><DataOd>2023-01-01</DataOd><DataDo>2023-12-31</DataDo></P_3>
<BilansJednostkaMala><Aktywa><KwotaA>1,5</KwotaA><KwotaB>bad</KwotaB><Aktywa_A><Empty/></Aktywa_A><Aktywa_B><B1><KwotaA/></B1><B2><KwotaA>2</KwotaA><KwotaB>3</KwotaB></B2></Aktywa_B></Aktywa></BilansJednostkaMala>
<RZiSJednostkaMala><RZiSKal><A><KwotaA>7</KwotaA><KwotaB>6</KwotaB><KwotaB1>5</KwotaB1></A><A><KwotaA>8</KwotaA></A></RZiSKal></RZiSJednostkaMala></SprFinJednostkaMalaWTysiacach>"""
HEADED = '<Unknown><KodSprawozdania kodSystemowy="SFJMIT (2)"/><BilansJednostkaMikro><Pasywa><KwotaA>4</KwotaA></Pasywa></BilansJednostkaMikro></Unknown>'


def parsed(spark, **docs):
    rows = st.element_rows(spark.createDataFrame(list(docs.items()), "doc_id string, content string"))
    head = st.headers(rows)
    return {r.doc_id: r for r in head.collect()}, st.nodes(rows, head)


def test_nodes_headers_and_errors(spark):
    head, tree = parsed(spark, small=SMALL, headed=HEADED, broken="<a><b></a>", empty="")
    assert (head["small"].schema_code, head["small"].multiplier, head["small"].name, head["small"].period_end, head["small"].rzis_variant) == ("SFJMAZ", 1000, "Test", "2023-12-31", "kalkulacyjny")
    assert (head["headed"].schema_code, head["headed"].multiplier) == ("SFJMIZ", 1000)
    assert head["broken"].reason_code == head["empty"].reason_code == "parse_error"
    got = [(r.tag, r.depth, r.kwota_a, r.kwota_b, r.kwota_b1) for r in tree.filter("doc_id = 'small'").orderBy("node_id").collect()]
    assert got == [("Aktywa", 0, 1500.0, 0.0, None), ("Aktywa_B", 1, 2000.0, 3000.0, None), ("B1", 2, 0.0, 0.0, None), ("B2", 2, 2000.0, 3000.0, None), ("RZiS.A", 0, 7000.0, 6000.0, 5000.0), ("RZiS.A", 0, 8000.0, 0.0, None)]
    assert {r.tag_path: r.value_current for r in st.line_items(tree).filter("doc_id = 'small'").collect()}["RZiS.A"] == 7000.0
    assert {r.tag: r.value for r in st.flat_values(tree).filter("doc_id = 'small'").collect()}["RZiS.A"] == 8000.0
    assert st.find_value(tree, "RZiS.A").first().value == 7000.0


def zipped(**files):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in files.items():
            z.writestr(f"d/{name.replace('_', '.')}", text)
    return held.getvalue()


def test_archives(spark):
    signed = f'<Signature xmlns:ds="http://www.w3.org/2000/09/xmldsig#"><ds:Object>{base64.b64encode(SMALL.encode()).decode()}</ds:Object></Signature>'
    rows = [("one", zipped(a_xml="<Note/>", b_xml=SMALL, c_xml=HEADED)), ("none", zipped(a_txt="x")), ("signed", zipped(a_xades=signed)), ("broken", b"PK nothing"), ("null", None)]
    _, items, ledger = st.ingest(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r.path, r.status, r.reason_code) for r in ledger.collect()} == {("one", "completed", None), ("signed", "completed", None), ("none", "failed", "no_xml_found"), ("broken", "failed", "unexpected_error"), ("null", "failed", "unexpected_error")}
    assert {r.doc_id for r in items.select("doc_id").distinct().collect()} == {"one", "signed"}


def test_archives_that_cannot_be_read_give_rows(spark):
    """Corrupt and encrypted members, deep nesting, equal base names, and the first xml where none is a statement."""
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/x.xml", SMALL)
    corrupt = bytearray(deflated.getvalue())
    corrupt[60:90] = b"\xff" * 30
    locked = bytearray(zipped(a_xml=SMALL))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    deep = "<JednostkaInna><Bilans><Aktywa>" + "<a>" * 2000 + "<KwotaA>1</KwotaA>" + "</a>" * 2000 + "</Aktywa></Bilans></JednostkaInna>"
    same = io.BytesIO()
    with zipfile.ZipFile(same, "w") as z:
        z.writestr("b/x.xml", SMALL.replace("2023-12-31", "2021-12-31"))
        z.writestr("a/x.xml", SMALL)
        z.writestr("c/y.xml", "<Note/>")
    rows = [("corrupt", bytes(corrupt)), ("locked", bytes(locked)), ("deep", zipped(a_xml=deep)), ("same", same.getvalue()), ("unparsed", zipped(a_xml="<a><b></a>")), ("note", zipped(a_xml="<Note/>"))]
    archives = spark.createDataFrame(rows, "path string, content binary")
    assert {r.path: r.type for r in st.members(archives).filter("path in ('corrupt', 'locked')").collect()} == {"corrupt": "error", "locked": "error"}
    chosen = {r.path: r for r in st.choose_statements(archives).collect()}
    assert chosen["same"].full_name == "a/x.xml" and chosen["note"].full_name == "d/a.xml" and not chosen["note"].is_statement
    ledger = {r.path: r.reason_code for r in st.ingest(archives)[2].collect()}
    assert ledger == {"corrupt": "no_xml_found", "locked": "no_xml_found", "deep": "parse_error", "same": None, "unparsed": "parse_error", "note": "invalid_period_end"}


def test_comparison_where_tags_repeat(spark):
    """The first match of a top tag anywhere, the last child of a tag under it, and nothing of another parent."""
    cols = "pair_id string, path string, tag string, ord int, kwota_a double, kwota_b double"
    frame = lambda *paths: spark.createDataFrame([("p", p, p.rsplit("/", 1)[-1], i, float(i + 1), 0.0) for i, p in enumerate(paths)], cols)
    now = frame("A", "A/B", "A/B/C", "A/D", "E", "E/B")
    old = frame("X", "X/A", "X/A/B", "X/A/B/C", "X/A/B", "X/E", "X/E/A", "X/E/A/D", "A", "A/B", "A/B/C", "A/D", "E", "E/B")
    got = sorted((r.current, r.previous) for r in st.compare(now, old).collect())
    # A is node 1 of old; its B is the later of two, which has no C; D is under another A alone; E is node 5, which has no B.
    assert got == [(1.0, 2.0), (2.0, 5.0), (3.0, None), (4.0, None), (5.0, 6.0), (6.0, None)]


def numbered(spark, *paths):
    """The nodes of paths in document order, with their parents' numbers."""
    rows, last = [], {}
    for i, p in enumerate(paths):
        above, _, tag = p.rpartition("/")
        rows.append(("p", i, last.get(above), p.count("/"), tag, float(i + 1), 0.5))
        last[p] = i
    return spark.createDataFrame(rows, "pair_id string, node_id int, parent_id int, depth int, tag string, kwota_a double, kwota_b double")


def test_comparison_by_numbers_where_tags_repeat(spark):
    """As by paths; and each of several equal nodes has its own parent."""
    now = numbered(spark, "A", "A/B", "A/B/C", "A/D", "E", "E/B", "A", "A/B")
    old = numbered(spark, "X", "X/A", "X/A/B", "X/A/B/C", "X/A/B", "X/E", "X/E/A", "X/E/A/D", "A", "A/B", "A/B/C", "A/D", "E", "E/B")
    got = sorted((r.current, r.previous, r.share_of_parent_current) for r in st.compare_trees(now, old).collect())
    assert [g[:2] for g in got] == [(1.0, 2.0), (2.0, 5.0), (3.0, None), (4.0, None), (5.0, 6.0), (6.0, None), (7.0, 2.0), (8.0, 5.0)]
    assert got[7][2] == round(8 / 7 * 100, 4)
    one = {r.current: (r.previous, r.share_of_parent_current) for r in st.compare_trees(now).collect()}
    assert one[2.0] == (0.5, 200.0) and one[1.0] == (0.5, None) and len(one) == 8
    assert st.compare_trees(now.limit(0), old).count() == 0 and st.compare_trees(now, old.limit(0)).filter("previous is not null").count() == 0


def test_two_statement_comparison(spark):
    cols = "pair_id string, path string, tag string, ord int, kwota_a double, kwota_b double"
    now = spark.createDataFrame([("p", "A", "A", 0, 10.0, 1.0), ("p", "A/B", "B", 1, 5.0, 1.0), ("p", "A/C", "C", 2, 5.0, 1.0), ("p", "D", "D", 3, -4.0, 1.0)], cols)
    old = spark.createDataFrame([("p", "X", "X", 0, 1.0, 0.0), ("p", "X/A", "A", 1, 20.0, 0.0), ("p", "X/A/B", "B", 2, 4.0, 0.0), ("p", "C", "C", 3, 9.0, 0.0), ("p", "D", "D", 4, -8.0, 0.0)], cols)
    got = {r.tag: (r.previous, r.change_percent, r.share_of_parent_current, r.share_of_parent_previous) for r in st.compare(now, old).collect()}
    assert got == {"A": (20.0, -50.0, None, None), "B": (4.0, 25.0, 50.0, 20.0), "C": (None, None, 50.0, None), "D": (-8.0, 50.0, None, None)}


def test_burst_detector_against_a_loop(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").filter("event_type = 'click'")
    want, state = {}, {}
    for e in sorted(events.withColumn("ts", F.col("ts").cast("timestamp")).collect(), key=lambda e: (e.user_id, e.ts, e.event_id)):
        us = e.ts.timestamp()
        count, began = state.get(e.user_id, (0, us))
        if us - began > 86400 * 30:
            count, began = 0, us
        count += 1
        want[e.event_id] = count >= 5
        state[e.user_id] = (0, us) if count >= 5 else (count, began)
    got = {r.event_id: r.fired for r in so.burst_detector(events, key="user_id", window_s=86400.0 * 30).collect()}
    assert got == want and any(want.values())


def test_streams_with_state_against_batches(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hits = events.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    streamed = so.run_to_end(sf.stream_burst_detector(so.stream_of(spark, hits, in_order="ts"), key="user_id", window_s=86400.0 * 30), "append")
    assert rows(streamed.select("key", "event_id", "fired")) == rows(so.burst_detector(hits, key="user_id", window_s=86400.0 * 30))


def test_streaks_over_blocks(spark):
    """Runs within a block, over several blocks, over blocks without a success, and over none."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), None if rng.random() < 0.04 else "e", f"2024-01-{1 + rng.randrange(28):02d} {rng.randrange(24):02d}:00:00") for i in range(600)]
    want, run = {}, {}
    for i, source, error, _ts in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        run[source] = run.get(source, 0) + 1 if error else 0
        if error:
            want[i] = run[source]
    frame = spark.createDataFrame(rows, "event_id long, source string, error string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.event_id: r.run for r in so.failure_streak(frame).collect()} == want and max(want.values()) > 40


def test_ranges_over_borders(spark):
    from ledgerline.operators import register as rg

    keys = [k for k in range(1, 95) if k not in (33, 47, 48)]
    frame = spark.createDataFrame([(k, "a" if k < 60 or k % 2 else "b") for k in keys], "key long, status string")
    got = sorted(tuple(r) for r in rg.not_found_ranges(frame, block=10).collect())
    assert [g for g in got if g[0] == "a"][:3] == [("a", 1, 32, 32), ("a", 34, 46, 13), ("a", 49, 59, 11)]
    assert sum(g[3] for g in got) == len(keys)


def test_a_registered_schema_is_read(spark):
    """V3: root tag, section elements and multiplier of a schema of one's own."""
    st.register_schema("OWN", {"roots": ["OwnReport"], "balance": "OwnBalance", "profit": "OwnProfit", "cash": None, "variants": False, "multiplier": 10, "extra": None})
    try:
        head, tree = parsed(spark, own="<OwnReport><OwnBalance><Aktywa><KwotaA>4</KwotaA></Aktywa></OwnBalance><OwnProfit><A><KwotaA>2</KwotaA></A></OwnProfit></OwnReport>")
        assert (head["own"].schema_code, head["own"].multiplier) == ("OWN", 10)
        assert {(r.tag, r.kwota_a) for r in tree.collect()} == {("Aktywa", 40.0), ("RZiS.A", 20.0)}
    finally:
        del st.SCHEMAS["OWN"]


@pytest.mark.parametrize(
    ("objects", "found"),
    [
        ("<ds:Object><q:QualifyingProperties xmlns:q='http://uri.etsi.org/01903/v1.3.2#'/></ds:Object><ds:Object><a><Bilans/></a></ds:Object>", "a"),
        ("<ds:Object><note/></ds:Object><ds:Object><other/><a><Bilans/></a></ds:Object>", "a"),  # beside other documents
        ("<ds:Object>bm8gWE1M</ds:Object><ds:Object Encoding='http://www.w3.org/2000/09/xmldsig#base64'>PGI+\n PFJaaVMvPjwvYj4=</ds:Object>", "b"),
        ("<ds:Object Encoding='utf-8'>&lt;c&gt;&lt;Bilans/&gt;&lt;/c&gt;</ds:Object>", "c"),
        ("<ds:Object><note/></ds:Object>", "note"),
        ("<ds:Object/><ds:Object> </ds:Object><ds:Object>%%%</ds:Object><ds:Object><ds:Manifest/></ds:Object>", None),
    ],
)
def test_what_signatures_carry(objects, found):
    root = ET.fromstring(f'<Signatures xmlns:ds="http://www.w3.org/2000/09/xmldsig#"><ds:Signature>{objects}</ds:Signature></Signatures>')
    if found:
        assert st.unwrap(root).tag == found
    else:
        with pytest.raises(ValueError):
            st.unwrap(root)


def test_nodes_and_items_of_archives_are_not_exchanged(spark):
    """What a node needs of its document is in its row, and the first of a tag is known where it is read."""
    xml = "<JednostkaMala><Naglowek><KodSprawozdania kodSystemowy='SFJMAT (1)'/><OkresDo>2020-12-31</OkresDo></Naglowek><BilansJednostkaMala><Aktywa><KwotaA>5</KwotaA><X><KwotaA>1</KwotaA></X></Aktywa><Pasywa><X><KwotaA>2</KwotaA></X></Pasywa></BilansJednostkaMala></JednostkaMala>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/s.xml", xml)
    archives = spark.createDataFrame([(str(i), held.getvalue() if i % 3 else b"") for i in range(9)], "path string, content binary")
    tree, items, ledger = st.ingest(archives)
    for df in (tree, items, ledger):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.tag_path, r.value_current) for r in items.collect()) == sorted((str(i), t, v) for i in range(9) if i % 3 for t, v in (("Aktywa", 5000.0), ("X", 1000.0), ("Pasywa", 2000.0)))
    assert {r.path: (r.reason_code, r.full_name) for r in ledger.collect()} == {str(i): (None, "a/s.xml") if i % 3 else ("unexpected_error", None) for i in range(9)}
    deep = "<!DOCTYPE r [<!ENTITY a '" + "<x>" * 300 + "</x>" * 300 + "'>]><r>" + "<x>" * 300 + "&a;" + "</x>" * 300 + "</r>"
    rows = st.element_rows(spark.createDataFrame([("deep", deep)], "doc_id string, content string"))
    assert [r.facts["reason_code"] for r in rows.collect()] == ["parse_error"] and len(xml) < 7 * st.MAX_DEPTH


def test_documents_of_one_form_are_walked_once(spark, monkeypatch):
    """What does not depend on texts is found once for documents of one form; texts, empty ones and attributes are each document's own."""
    made, form = [], st._Form
    monkeypatch.setattr(st, "_Form", lambda *given: made.append(1) or form(*given))
    doc = lambda i: SMALL.replace("1,5", str(i)).replace("123", "" if i % 2 else str(i)).replace("2023-12-31", f"{2000 + i}-12-31")
    reader = st._Reader(dict(st.SCHEMAS))
    docs = [reader.rows(str(i), x.encode()) for i in range(6) for x in (doc(i), HEADED.replace("SFJMIT", f"SFJMI{i}"))]
    assert len(made) == 2
    rows = pa.Table.from_batches(st._row_batches(iter(docs))).to_pylist()
    top = [(r["doc_id"], r["a"], r["period_end"]) for r in rows if r["tag"] == "Aktywa"]
    assert top == [(str(i), str(i), f"{2000 + i}-12-31") for i in range(6)]
    heads = [dict(r["facts"]) for r in rows if r["kind"] == "header"]
    assert [(h.get("krs"), h["raw_code"]) for h in heads] == [x for i in range(6) for x in ((None if i % 2 else str(i), ""), (None, f"SFJMI{i} (2)"))]
    only = pa.Table.from_batches(st._row_batches(iter(docs), False)).to_pylist()
    assert only == [r for r in rows if r["kind"] == "header"]


def test_a_ledger_alone_makes_no_element_rows(spark, monkeypatch):
    monkeypatch.setattr(st, "stage", lambda *a: pytest.fail("elements are staged"))
    rows = [("one", zipped(a_xml="<Note/>", b_xml=SMALL)), ("none", zipped(a_txt="x"))]
    tree, items, ledger = st.ingest(spark.createDataFrame(rows, "path string, content binary"), staged=False, only_ledger=True)
    assert {(r.path, r.reason_code) for r in ledger.collect()} == {("one", None), ("none", "no_xml_found")}
    assert tree.count() == items.count() == 0


def test_comparison_writes_what_it_reads(spark, monkeypatch):
    from ledgerline.fixtures import Tables
    from ledgerline.plans import trees

    made = {}
    monkeypatch.setattr(trees, "stage", lambda df, label: made.setdefault(label, df))
    t = Tables(spark, "/root/testdata/sf0.001")
    trees._both_years(t, t.fx_reports.select(F.col("id").alias("pair_id"), F.col("id").alias("prior_id")))
    assert {k: set(df.columns) for k, df in made.items()} == {"nodes-now": {"pair_id", "node_id", "parent_id", "tag", "kwota_a", "depth"}, "nodes-prior": {"pair_id", "node_id", "parent_id", "tag", "kwota_a"}}


def test_documents_with_the_same_tags_are_parsed_once(spark, monkeypatch):
    """What lies between known tags is taken as it is; whatever else a parser would make of it, or of the tags, is left to one."""
    parsed, parse = [], st.ET.fromstring
    monkeypatch.setattr(st.ET, "fromstring", lambda text: parsed.append(text) or parse(text))
    signed = lambda x: f'<Signature xmlns:ds="http://www.w3.org/2000/09/xmldsig#"><ds:Object>{x}</ds:Object></Signature>'
    plain = [SMALL.replace("1,5", str(i)).replace("123", "" if i % 2 else "x y") for i in range(4)]
    reader = st._Reader(dict(st.SCHEMAS))
    for form in (lambda x: x, signed, lambda x: f'<?xml version="1.0" encoding="UTF-8"?>\n{x}\n'):
        parsed.clear()
        assert [reader.rows("d", form(x).encode())[5:] for x in plain] == [st._Reader(dict(st.SCHEMAS)).rows("d", form(x).encode())[5:] for x in plain]
        assert len(parsed) == 1 + len(plain)
    odd = [SMALL.replace("1,5", x) for x in ("1&amp;5", "1&5", "1]]>5", "1\r5", "1\x015", "1\ufffe5", "1<!--c-->5", "1<![CDATA[5]]>", "1\ufffd5", "1\x855", "1<5", "1>5", ">1<5", "1</KwotaA<KwotaA>5")]
    odd += [SMALL + "x", "x" + SMALL, "\ufeff" + SMALL, "\n" + SMALL + " ", SMALL[:-1], SMALL + "<a", '\n<?xml version="1.0" encoding="UTF-8"?>\n' + SMALL, '<?xml version="1.0" encoding="UTF-8"?>x' + SMALL]
    odd += [signed(base64.b64encode(x.encode()).decode()) for x in plain] + [SMALL.replace("<Empty/>", f'<Empty a="{x}"/>') for x in ("1>2", "1>3", "/")]
    for x in [*odd, *odd]:
        assert reader.rows("d", x.encode())[1:] == st._Reader(dict(st.SCHEMAS)).rows("d", x.encode())[1:]


def test_plain_archives_are_read_as_zipfile_reads_them(monkeypatch):
    """Members of plain archives without zipfile; whatever is not plain, and what is wrong, as it says."""
    from ledgerline.plans import trees

    def told(content):
        try:
            return [(name, size, _try(unpack)) for name, size, unpack in st._files(content)]
        except Exception as e:  # noqa: BLE001
            return str(e)

    def _try(unpack):
        try:
            return unpack()
        except Exception as e:  # noqa: BLE001
            return str(e)

    files = [("b/x.xml", SMALL), ("b/", ""), ("a/x.xml", "<a/>"), ("a/x.xml", ""), ("c", "\u0142" * 999)]
    made = [trees._zip(files, deflate) for deflate in (False, True)] + [trees._zip([]), b"", b"PK"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"c"
        z.writestr("\u0142.xml", SMALL)
    made.append(packed.getvalue())
    assert all(st._plain_files(m) is not None for m in made[:3]) and not any(st._plain_files(m) for m in made[3:])
    for m in list(made):
        made += [m[: len(m) // 2], m + b"x", b"x" + m]
        made += [m[:i] + bytes([m[i] ^ 0x21]) + m[i + 1 :] for i in range(0, len(m), 5)]
    got = [told(m) for m in made]
    monkeypatch.setattr(st, "_plain_files", lambda content: None)
    assert got == [told(m) for m in made]


def test_the_code_of_a_document_is_looked_for_once(spark):
    """Each row of nodes and items asks for a multiplier and a schema, both of which the header code decides."""
    _, items, _ = st.ingest(spark.createDataFrame([], "path string, content binary"), staged=False)
    assert items._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2


def test_documents_in_envelopes_as_base64_are_parsed_once(spark, monkeypatch):
    """Neither the envelope nor what it carries, broken into lines or not; what is not plain is left to a parser."""
    parsed, parse = [], st.ET.fromstring
    held = lambda b: f'<Signatures xmlns:ds="http://www.w3.org/2000/09/xmldsig#"><ds:Object><q:Q xmlns:q="http://uri.etsi.org/01903/v1#"/></ds:Object><ds:Object>{b}</ds:Object></Signatures>'.encode()
    signed = lambda x: held(base64.encodebytes(x).decode().replace("\n", "\r\n"))
    plain = [SMALL.replace("1,5", str(i)).encode() for i in range(6)]
    fresh = lambda x: st._Reader(dict(st.SCHEMAS)).rows("d", x)[1:]
    want = [fresh(signed(x)) for x in plain]
    monkeypatch.setattr(st.ET, "fromstring", lambda text: parsed.append(text) or parse(text))
    reader = st._Reader(dict(st.SCHEMAS))
    assert [reader.rows("d", signed(x))[1:] for x in plain] == want
    assert len(parsed) <= 4
    odd = [b"<?xml version='1.0' encoding='ISO-8859-2'?>" + plain[0].replace(b"123", b"\xb1"), plain[0][:-3], b"<Signature/>", b"", b"text", b" " + plain[0], "<a>ł</a>".encode(), plain[0].replace(b"123", b"1&amp;2"), b"<a>\0</a>"]
    for x in odd:
        assert reader.rows("d", signed(x))[1:] == fresh(signed(x))
    assert reader.rows("d", held("?"))[1:] == fresh(held("?"))


def test_units_of_documents_are_those_of_the_columns(spark):
    """they are worked out once a document and no longer by a pattern in each of its rows."""
    codes = ["SFJINZ (1)", " sfjmat(2)", "SFZURT", "SFZURZ", "", "-", "X", "SFJMIT-1", "ſfjinz"]
    roots = [None, "", "JednostkaInna", "JednostkaMalaWTys", "ZakladUbezpieczen", "SprFinJednostkaOPPWZlotych", "Other"]
    rows = spark.createDataFrame([(c, r) for c in codes for r in roots], "c string, r string")
    of = st._units(dict(st.SCHEMAS))
    for x in st._with_units(rows, F.col("c"), F.col("r")).collect():
        assert of(x.c, x.r) == (x._schema, x._multiplier), x
    _, items, _ = st.ingest(spark.createDataFrame([], "path string, content binary"), staged=False)
    assert "regexp_extract" not in items._jdf.queryExecution().optimizedPlan().toString()


def test_only_fields_that_are_asked_for_are_made(spark):
    docs = spark.createDataFrame([("d", SMALL)], "doc_id string, content string")
    few = st.element_rows(docs, staged=False, fields=("a", "kind", "doc_id", "tag", "multiplier"))
    assert few.columns == ["doc_id", "kind", "tag", "a", "multiplier"]
    every = st.nodes(st.element_rows(docs, staged=False)).select("doc_id", "tag", "kwota_a").collect()
    assert st.nodes(few).collect() == every and len(every) > 1


def test_comparison_of_random_trees_against_a_loop(spark):
    """Repeated tags, gaps in numbers, null tags and amounts, and pairs without a tree on the other side."""
    rng = random.Random(5)

    def tree(pair):
        rows = []
        for i in range(rng.randrange(1, 30)):
            up = rng.choice([None, *rows[-6:]])
            rows.append((pair, 3 * i, up and up[1], up[3] + 1 if up else 0, rng.choice([*"ABC", None]), rng.choice([None, float(rng.randrange(9))]), 0.0))
        return rows

    now, old = {p: tree(p) for p in range(60)}, {p: tree(p) for p in range(10, 70)}
    want = []
    for p, nodes in now.items():
        met, others = {}, old.get(p, [])
        for _, i, up, _, tag, _, _ in nodes:
            some = [o for o in others if tag is not None and o[4] == tag and (up is None or (up in met and o[2] == met[up][1]))]
            if some:
                met[i] = some[0] if up is None else some[-1]
        for _, i, up, _, tag, a, _ in nodes:
            b, of = met[i][5] if i in met else None, {n[1]: n[5] for n in nodes}.get(up)
            want.append((p, tag, a, b, round(a / of * 100, 4) if a is not None and of else None))
    cols = "pair_id int, node_id long, parent_id long, depth int, tag string, kwota_a double, kwota_b double"
    frame = lambda trees: spark.createDataFrame([n for t in trees.values() for n in t], cols).repartition(3)
    got = [(r.pair_id, r.tag, r.current, r.previous, r.share_of_parent_current) for r in st.compare_trees(frame(now), frame(old)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[3] is not None for w in want) > 50


def test_comparison_deals_statements_and_not_their_nodes(spark):
    """A pair's two trees meet as one row each: nodes are dealt once, whatever the depth."""
    from ledgerline.fixtures import Tables
    from ledgerline.plans import trees

    t = Tables(spark, "/root/testdata/sf0.001")
    now, old = trees._both_years(t, t.fx_reports.select(F.col("id").alias("pair_id"), F.col("id").alias("prior_id")))
    assert now.count() == t.fx_tree.select("doc_id").distinct().count() and old.count() == t.fx_reports.count()
    plan = st.compare_packed(now, old)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2 and plan.count("Scan parquet") == 2
