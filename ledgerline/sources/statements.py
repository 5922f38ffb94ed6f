"""Statements as rows: archives to XML members to element rows; all that follows is relational.

Python does only what needs a parser: a ZIP's members, a signed envelope, and the elements of one document.
A document that cannot be read gives a row with its reason instead of an exception: broken, encrypted and unknown
archives, members that do not unpack, XML that does not parse or is nested deeper than MAX_DEPTH elements.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import catalog
from ledgerline.functions import scalars as sc
from ledgerline.operators.versions import latest
from ledgerline.storage import stage, workers_import_us

# Per schema its root tags, section elements, multiplier and extra section.
SCHEMAS: dict[str, dict] = {
    "SFJINZ": {"roots": ["JednostkaInna", "SprFinJednostkaInnaWZlotych", "JednostkaInnaWTys", "SprFinJednostkaInnaWTysiacach"], "balance": "Bilans", "profit": "RZiS", "cash": "RachPrzeplywow", "variants": True, "multiplier": 1, "extra": ("ZestZmianWKapitale", "equity_changes", "EQ.")},
    "SFJMAZ": {"roots": ["JednostkaMala", "SprFinJednostkaMalaWZlotych", "JednostkaMalaWTys", "SprFinJednostkaMalaWTysiacach"], "balance": "BilansJednostkaMala", "profit": "RZiSJednostkaMala", "cash": None, "variants": True, "multiplier": 1, "extra": None},
    "SFJMIZ": {"roots": ["JednostkaMikro", "SprFinJednostkaMikroWZlotych", "JednostkaMikroWTys", "SprFinJednostkaMikroWTysiacach"], "balance": "BilansJednostkaMikro", "profit": "RZiSJednostkaMikro", "cash": None, "variants": False, "multiplier": 1, "extra": None},
    "SFJOPZ": {"roots": ["JednostkaOp", "SprFinJednostkaOPPWZlotych", "JednostkaOpWTys", "SprFinJednostkaOPPWTysiacach", "JednostkaOrganizacjiPozarzadowej"], "balance": "BilansJednostkaOp", "profit": "RZiSJednostkaOp", "cash": None, "variants": False, "multiplier": 1, "extra": None},
    "SFZURT": {"roots": ["ZakladUbezpieczenWTys", "SprFinZakladUbezpieczenWTysiacach", "ZakladUbezpieczenWZlotych", "SprFinZakladUbezpieczenWZlotych", "ZakladUbezpieczen"], "balance": "BilansZakladUbezpieczen", "profit": "RZiSZakladUbezpieczen", "cash": "PrzeplywyZakladUbezpieczen", "variants": False, "multiplier": 1000, "extra": ("PozabilansoweZakladUbezpieczen", "off_balance_sheet", "OBS.")},
}
MARKERS = ("Bilans", "RZiS", "RachPrzeplywow", "Przeplyw")
AMOUNTS = ("KwotaA", "KwotaB", "KwotaB1")
#: Statements are some ten elements deep; what is nested deeper than this is taken for broken.
MAX_DEPTH = 500
_BROKEN = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError, ValueError)
_SIGNED = "{http://www.w3.org/2000/09/xmldsig#}Object"
#: Namespaces of what signatures say of themselves (fixed values).
_SIGNATURE_DATA = ("{http://uri.etsi.org/01903/", "{http://www.w3.org/2000/09/xmldsig#}")

_ROWS = "doc_id string, kind string, section string, node_id int, parent_id int, depth int, raw_tag string, tag string, path string, has_amount boolean, a string, b string, b1 string, facts map<string,string>, is_first boolean, root_tag string, raw_code string, period_end string, schema_code string, multiplier int"
_FIELDS = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
#: Columns that all documents of a form have alike, see _Form.
_SHARED = ("kind", "section", "node_id", "parent_id", "depth", "raw_tag", "tag", "path", "has_amount", "is_first")
#: Elements of forms that a task keeps at a time.
_FORMS = 1 << 17
#: Rows, and bytes of what they hold, that go to Spark at once.
_BATCH, _BYTES = 4096, 1 << 22


def register_schema(code: str, config: dict) -> None:
    """V3: add a schema; its root tags and section elements take part from the next job on."""
    SCHEMAS[code] = config


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _has_sections(root: ET.Element) -> bool:
    return any(_bare(e.tag).startswith(MARKERS) for e in root.iter())


def _carried(held: ET.Element) -> list[ET.Element]:
    """The documents that a signature's Object carries: child elements of no signature namespace, or its text, decoded as its Encoding says (base64 by default)."""
    if len(held):
        return [e for e in held if not e.tag.startswith(_SIGNATURE_DATA)]
    text, plain = held.text or "", not held.get("Encoding", "base64").endswith("base64")
    try:
        return [ET.fromstring(text if plain else base64.b64decode(text))] if text.strip() else []
    except (ET.ParseError, ValueError):  # pictures, certificates and other data
        return []


def unwrap(root: ET.Element) -> ET.Element:
    """The document that an envelope of signatures is about: of all that its Objects carry, the first with a section of a statement, else the first. Other documents are taken as they are."""
    if _bare(root.tag) not in ("Signatures", "Signature"):
        return root
    carried = [document for held in root.iter(_SIGNED) for document in _carried(held)]
    if not carried:
        raise ValueError("the envelope carries no document")
    return next(filter(_has_sections, carried), carried[0])


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2IH"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")


def _plain_files(content: bytes) -> list[tuple[str, int, Callable[[], bytes]]] | None:
    """What _files gives, of archives of the plainest kind: ASCII names, members stored or deflated one after the other, no extras. None for all others, and for what zipfile might find fault with."""
    if len(content) < _END.size:
        return None
    sign, disk, first_disk, here, n, size, at, comment = _END.unpack_from(content, len(content) - _END.size)
    if sign != b"PK\5\6" or disk or first_disk or here != n or comment or at + size != len(content) - _END.size:
        return None
    found, end, stop = [], 0, at + size
    for _ in range(n):
        if at + _ENTRY.size > stop:
            return None
        sign, _, needs, flags, method, time, date, crc, packed, full, name, extra, comment, disk, _, _, start = _ENTRY.unpack_from(content, at)
        raw = content[at + _ENTRY.size : at + _ENTRY.size + name]
        at += _ENTRY.size + name
        if sign != b"PK\1\2" or needs & 255 > 20 or flags not in (0, 0x800) or method not in (0, 8) or extra or comment or disk or start < end or start + _LOCAL.size > stop - size:
            return None
        local = _LOCAL.unpack_from(content, start)
        data = start + _LOCAL.size + name
        end = data + packed
        if local[0] != b"PK\3\4" or local[2:9] != (flags, method, time, date, crc, packed, full) or local[9:] != (name, 0) or content[start + _LOCAL.size : data] != raw or end > stop - size or not raw.isascii() or b"\0" in raw:
            return None
        if not raw.endswith(b"/"):
            found.append((raw.decode(), full, lambda k=len(found), a=data, b=end, m=method, c=crc, f=full: _unpacked(content, k, a, b, m, c, f)))
    return sorted(found, key=itemgetter(0)) if at == stop else None


def _unpacked(content: bytes, number: int, start: int, end: int, method: int, crc: int, size: int) -> bytes:
    """A member by its place; where that is not what the directory says, zipfile tells what is wrong with it. number: its own among the files."""
    try:
        data = content[start:end]
        if method:
            inflate = zlib.decompressobj(-15)
            data = inflate.decompress(data, size + 1)
        if len(data) == size and zlib.crc32(data) == crc:
            return data
    except zlib.error:
        pass
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read([i for i in z.infolist() if not i.is_dir()][number])


def _files(content: bytes | None) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """The files of an archive by full name, each with its size and a function that unpacks it."""
    content = content or b""
    plain = _plain_files(content)
    if plain is not None:
        yield from plain
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
            yield i.filename, i.file_size, lambda i=i: z.read(i)


def _batches(rows: Iterator[tuple], types: list | tuple, names: list[str], held: int | None = None) -> Iterator[pa.RecordBatch]:
    """rows as batches; held: the column whose bytes count too."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[held] or b"") if held is not None else 0
        if len(some) >= _BATCH or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def _units(schemas: dict[str, dict]) -> Callable[[str | None, str | None], tuple[str | None, int | None]]:
    """Schema and multiplier of a document with a raw code and root tag, as header_code, detect_schema and unit_multiplier have them; once a document, and those of the last ones are kept."""
    roots = {r: c for c, one in schemas.items() for r in one["roots"]}

    @lru_cache(4096)
    def of(raw: str | None, root: str | None) -> tuple[str | None, int | None]:
        if raw is None:
            return None, None
        code, tag = re.match("[A-Z0-9]*", raw.strip(" ").upper())[0], (root or "").upper()
        schema = catalog.HEADER_CODES.get(code) or roots.get(root) or "SFJINZ"
        known = 1000 if code.endswith("T") else 1 if code.endswith("Z") else 1000 if "WTYS" in tag else 1 if "WZLOT" in tag else None
        return schema, known or (schemas[schema]["multiplier"] if schema in schemas else None)

    return of


def _row_batches(documents: Iterator[tuple], nodes: bool = True, fields: Sequence[str] = tuple(_FIELDS), schemas: dict[str, dict] = SCHEMAS) -> Iterator[pa.RecordBatch]:
    """The fields of rows of documents, each (form, doc_id, facts, root_tag, raw_code, period_end, a, b, b1), as batches. nodes=False: only the last row of each."""
    like = [n for n in _SHARED if n in fields]
    units = _units(schemas)

    def made(some: list[tuple]) -> pa.RecordBatch:
        forms, doc_ids, facts, roots, codes, periods, *amounts = zip(*some, strict=True)
        place, held, end = {}, [], 0
        for f in forms:
            if id(f) not in place:
                place[id(f)] = end
                held.append(f.shared)
                end += f.size
        size = np.array([f.size for f in forms])
        start = np.array([place[id(f)] for f in forms])
        last = np.cumsum(size) - 1
        if nodes:
            of = np.repeat(np.arange(len(some)), size)
            within = np.arange(len(of)) - np.repeat(last - size + 1, size)
            rows, is_last = np.repeat(start, size) + within, np.zeros(len(of), bool)
            is_last[last] = True
        else:
            of, rows, is_last = np.arange(len(some)), start + size - 1, np.ones(len(some), bool)
        shared = pa.Table.from_batches(held).select(like).combine_chunks().take(pa.array(rows)).combine_chunks()
        alike = {"doc_id": doc_ids, "root_tag": roots, "raw_code": codes, "period_end": periods}
        alike["schema_code"], alike["multiplier"] = zip(*map(units, codes, roots), strict=True)
        whose = pa.array(of)
        columns = {n: pa.array(v, _TYPES[_FIELDS.index(n)]).take(whose) for n, v in alike.items() if n in fields}
        columns |= {n: shared.column(n).chunk(0) for n in like}
        columns |= {n: pa.array([x for one in v for x in one], pa.string()) if nodes else pa.nulls(len(some), pa.string()) for n, v in zip(("a", "b", "b1"), amounts, strict=True) if n in fields}
        if "facts" in fields:
            columns["facts"] = pa.array(facts, _TYPES[_FIELDS.index("facts")]).take(pa.array(of, mask=~is_last))
        return pa.RecordBatch.from_arrays([columns[f] for f in fields], list(fields))

    some, size = [], 0
    for one in documents:
        some.append(one)
        size += one[0].size if nodes else 1
        if size >= _BATCH:
            yield made(some)
            some, size = [], 0
    if some:
        yield made(some)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The two columns of batches, row by row, a few of which are unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            some = batch.slice(at, 32)
            yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


def members(archives: DataFrame, *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, full_name, name, size, type, content) of each file in each archive, folders flattened in name.

    Archives and members that cannot be read give a row of type error, with the message as content.
    """
    workers_import_us(archives.sparkSession)
    names, types = ["path", "full_name", "name", "size", "type", "content"], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def rows_of(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for full_name, size, unpack in _files(content):
                name = full_name.rsplit("/", 1)[-1]
                try:
                    yield path, full_name, name, size, name.rpartition(".")[2].lower() if "." in name else "", unpack()
                except _BROKEN as e:
                    yield path, full_name, name, size, "error", str(e).encode()
        except _BROKEN as e:
            yield path, None, None, 0, "error", str(e).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for path, content in _each(batches) for row in rows_of(path, content)), types, names, 5)

    return archives.select(path_col, content_col).mapInArrow(run, "path string, full_name string, name string, size long, type string, content binary")


def _document(content: bytes) -> ET.Element:
    return unwrap(ET.fromstring(content.decode("utf-8", "replace")))


def is_statement(content: bytes) -> bool:
    """Whether the XML parses and holds an element of a statement's sections."""
    try:
        return _has_sections(_document(content))
    except (ET.ParseError, ValueError):
        return False


def _pick(content: bytes | None, reader: _Reader) -> tuple:
    """(full_name, name, content, is_statement, reason_code, document) of an archive, see choose_statements; document is a statement as reader has read it."""
    first = None
    try:
        for full_name, _, unpack in _files(content):
            if full_name.lower().endswith((".xml", ".xades")):
                try:
                    found = unpack()
                except _BROKEN:
                    continue
                name = full_name.rsplit("/", 1)[-1]
                try:
                    document = reader.read(found)
                    if document[0].is_statement:
                        return full_name, name, found, True, None, document
                except (ET.ParseError, ValueError):
                    pass
                first = first or (full_name, name, found, False, None, None)
    except _BROKEN:
        return None, None, None, False, "unexpected_error", None
    return first or (None, None, None, False, "no_xml_found", None)


def choose_statements(archives: DataFrame, *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, full_name, name, content, is_statement, reason_code) of each archive, one row each.

    It is the first member by full name, of type xml or xades, that is a statement; members after it are not unpacked.
    Where none is, it is the first member of such a type that unpacks, with is_statement false; where there is none,
    content is null and reason_code no_xml_found, or unexpected_error for an archive that cannot be read.
    """
    workers_import_us(archives.sparkSession)
    names, types = ["path", "full_name", "name", "content", "is_statement", "reason_code"], (pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string())

    schemas = dict(SCHEMAS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(schemas)
        yield from _batches(((path, *_pick(content, reader)[:5]) for path, content in _each(batches)), types, names, 3)

    return archives.select(path_col, content_col).mapInArrow(run, "path string, full_name string, name string, content binary, is_statement boolean, reason_code string")


def _too_deep(root: ET.Element) -> bool:
    level = [root]
    for _ in range(MAX_DEPTH):
        level = [c for e in level for c in e]
        if not level:
            return False
    return True


class _Form:
    """What all documents with the same elements in the same order and nesting have alike: their rows but for texts, and where those stand.

    shared: the rows' columns _SHARED, nodes first, then the header. amounts: where, among all elements in document order,
    the texts of a, b and b1 of each row stand; one place beyond the last for none. facts: the elements that each fact may
    be in, the first with a text counts; more: what is known without texts. code: the element of the header code.
    """

    def __init__(self, root: ET.Element, elements: list[ET.Element], schemas: dict[str, dict]) -> None:
        self.shared, self.size, self.deep = _NO_NODES, 1, _too_deep(root)
        if self.deep:
            return
        at = {e: i for i, e in enumerate(elements)}
        there: dict[str, ET.Element] = {}  # the first element of each tag, as find() has it: without the root
        for e in elements:
            tag = e.tag
            e.tag = tag = tag[tag.rfind("}") + 1 :]
            if tag not in there and e is not root:
                there[tag] = e

        def places(*paths: str) -> list[int]:
            found = []
            for p in paths:
                above, _, below = p.partition("/")
                e = there.get(above)
                if below and e is not None:
                    e = e.find(below)
                    e = root.find(f".//{p}") if e is None else e
                if e is not None:
                    found.append(at[e])
            return found

        self.root_tag, self.code = root.tag, at.get(there.get("KodSprawozdania"))
        self.facts = [
            (k, places(*paths)) for k, paths in (
                ("name", ("NazwaFirmy",)), ("krs", ("P_1E", "P_1C")), ("nip", ("P_1D", "P_1B")), ("pkd", ("KodPKD",)), ("period_start", ("P_3/DataOd", "P_2A/DataOd", "OkresOd")),
                ("period_end", ("P_3/DataDo", "P_2A/DataDo", "OkresDo")), ("date_prepared", ("DataSporzadzenia",)),
            )
        ]
        self.more: dict[str, str | None] = {}
        seen: set[tuple[str, str]] = set()
        out: list[tuple] = []
        none = len(elements)
        amounts_at: list[tuple[int, ...]] = []

        def walk(element: ET.Element, section: str, prefix: str) -> None:
            """Rows of element and all below it, in document order, but for those without an amount in or below them."""
            found: list[tuple] = []
            ahead = [(element, -1, 0, "")]
            item = "Bilans" if section in ("aktywa", "pasywa") else section
            while ahead:
                e, parent, depth, above = ahead.pop()
                tag, here = prefix + e.tag, len(found)
                path = f"{above}/{tag}" if above else tag
                below, amounts = [], {}
                for c in e:
                    if c.tag in AMOUNTS:
                        amounts.setdefault(c.tag, c)
                    else:
                        below.append((c, here, depth + 1, path))
                ahead += reversed(below)
                found.append((parent, depth, e.tag, tag, path, *map(amounts.get, AMOUNTS)))
            # Whose amounts count for each: its own, or those of its last child that has any.
            source = [i if f[5] is not None else None for i, f in enumerate(found)]
            for i in range(len(found) - 1, 0, -1):
                if source[i] is not None and source[found[i][0]] is None:
                    source[found[i][0]] = source[i]
            number = {-1: None}
            for i, (parent, depth, raw, tag, path, *amounts) in enumerate(found):
                if source[i] is not None:
                    number[i] = len(out)
                    counted = [*found[source[i]][5:7], amounts[2]]
                    is_first = (item, tag) not in seen
                    seen.add((item, tag))
                    out.append(("node", section, len(out), number[parent], depth, raw, tag, path, amounts[0] is not None, is_first))
                    amounts_at.append(tuple(none if e is None else at[e] for e in counted))

        def first(*names: str | None) -> ET.Element | None:
            return next((there[n] for n in names if n in there), None)

        balance = first(*[s["balance"] for s in schemas.values()])
        for part, section in (("Aktywa", "aktywa"), ("Pasywa", "pasywa")):
            e = None if balance is None else balance.find(part)
            if e is not None:
                walk(e, section, "")
        for kind, section, prefix, variants in (("profit", "rzis", "RZiS.", {"RZiSPor": "porownawczy", "RZiSKalk": "kalkulacyjny", "RZiSKal": "kalkulacyjny"}), ("cash", "cash_flow", "CF.", {"PrzeplywyPosr": "posrednia", "PrzeplywyBezp": "bezposrednia"})):
            for s in schemas.values():
                e = first(s[kind])
                if e is None:
                    continue
                if s["variants"]:
                    name = next((n for n in variants if e.find(n) is not None), None)
                    self.more["rzis_variant" if kind == "profit" else "cf_method"] = variants.get(name)
                    e = None if name is None else e.find(name)
                for c in e if e is not None else ():
                    walk(c, section, prefix)
                break
        for s in schemas.values():
            e = first(s["extra"][0]) if s["extra"] else None
            for c in e if e is not None else ():
                walk(c, s["extra"][1], s["extra"][2])
        rows = [*out, ("header", *[None] * (len(_SHARED) - 1))]
        self.size = len(rows)
        self.shared = pa.RecordBatch.from_arrays([pa.array(c, _TYPES[_FIELDS.index(n)]) for n, c in zip(_SHARED, zip(*rows, strict=True), strict=True)], list(_SHARED))
        # The header's own place is the one for none, twice, so that there is a tuple to get.
        self.amounts = [itemgetter(*c, none, none) for c in zip(*amounts_at, strict=True)] or [itemgetter(none, none)] * 3


_NO_NODES = pa.RecordBatch.from_arrays([pa.array(["error"] if n == "kind" else [None], _TYPES[_FIELDS.index(n)]) for n in _SHARED], list(_SHARED))


class _Error:
    """The form of what cannot be read: one row."""

    shared, size = _NO_NODES, 1


def _error(doc_id: str, reason: str, **facts: str | None) -> tuple:
    return _Error, doc_id, [*{"reason_code": reason, **{k: v for k, v in facts.items() if v is not None}}.items()], None, None, None, *[(None,)] * 3


#: Bytes that need no second look in a document, see _Reader; what marks a tag there, as no document holds it.
_FINE, _MARK = bytes([9, 10, *range(32, 256)]), "\1"


class _Read:
    """A document as it was parsed: its form, whether it has sections of a statement, and what attributes say of its header code. places: where its texts are among the pieces of it, for those with the same tags."""

    def __init__(self, form: _Form, is_statement: bool, code: ET.Element | None) -> None:
        self.form, self.is_statement, self.places, self.pieces = form, is_statement, None, 0
        self.raw_code = None if code is None else next((v for k, v in code.attrib.items() if _bare(k) == "kodSystemowy"), None)


class _Envelope:
    """Tags of an envelope whose Objects carry nothing but for one, which has a document as base64: where that is among its pieces."""

    def __init__(self, place: int, pieces: int) -> None:
        self.place, self.pieces = place, pieces


class _Reader:
    """Reads documents; their forms are kept, as most statements share one with others, up to _FORMS elements.

    A document with the very tags of one that has been parsed, attributes and blanks included, is as well formed as that
    one, as long as what lies between tags is plain text: so its texts are taken from between them and it is not parsed
    again. Where anything else may be between them (references, comments, sections of data, control
    characters), it is. Texts decide what an envelope with data carries; where it can only be one document, that is read
    in the same way, if it is ASCII without a declaration and no envelope itself. nodes=False: amounts are not asked for.
    """

    def __init__(self, schemas: dict[str, dict], nodes: bool = True) -> None:
        self.schemas, self.nodes, self.forms, self.held = schemas, nodes, {}, 0
        # By the tags' text, each with its mark; so many marks as every second piece has are so many tags.
        self.known: dict[str, _Read | _Envelope] = {}
        self.tags = 0

    def _form(self, root: ET.Element, elements: list[ET.Element]) -> _Form:
        # Tags in document order with the number of children of each tell the whole tree.
        shape = tuple([e.tag for e in elements]), tuple(map(len, elements))
        form = self.forms.get(shape)
        if form is None:
            form = _Form(root, elements, self.schemas)
            if self.held + len(elements) > _FORMS:
                self.forms, self.held = {}, 0
            if len(elements) <= _FORMS:
                self.forms[shape] = form
                self.held += len(elements)
        return form

    def _keep(self, read: _Read, tags: tuple[str, ...], pieces: list[str | None], document: ET.Element, elements: list[ET.Element], held: ET.Element | None = None) -> None:
        """Keep read for documents with the same tags, if the texts of this one are what lies behind its elements' tags. held: the one Object that carries something, as text; then the envelope is kept."""
        every = list(document.iter())
        starts = [k for k, t in enumerate(tags) if t[1:2] != "/"]
        starts = starts[1:] if tags[0][1:2] == "?" else starts
        if len(starts) != len(every) or len(tags) > _FORMS or any(t[:1] != _MARK for t in tags) or any(tags[k][1:2] in ("!", "?", "") for k in starts):
            return
        # Behind a tag that closes itself is no text of its element: there the place of none counts, which is the last.
        places = [len(pieces) - 1 if tags[k][-1:] == "/" else 2 * k + 2 for k in starts]
        if any((pieces[p] or None) != (e.text or None) for p, e in zip(places, every, strict=True)):
            return
        at = {id(e): p for e, p in zip(every, places, strict=True)}
        if held is not None:
            read = _Envelope(at[id(held)], len(pieces))
        elif all(id(e) in at for e in elements):
            read.places, read.pieces = itemgetter(*[at[id(e)] for e in elements], -1), len(pieces)
        else:
            return
        if self.tags + len(tags) > _FORMS:
            self.known, self.tags = {}, 0
        self.known["".join(tags)] = read
        self.tags += len(tags)

    def read(self, content: bytes, carried: bool = False) -> tuple[_Read, list[str | None]]:
        """A document and the texts of its elements in document order, with one for none at the end. carried: by an envelope, so it is taken as it is."""
        if b"\r" in content:  # ends of lines as a parser has them
            content = content.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        text, tags = content.decode("utf-8", "replace"), ()
        if not content.translate(None, _FINE) and "&" not in text and "]]>" not in text and "\ufffe" not in text and "\uffff" not in text:
            # Texts and tags by turns, if every second piece has the mark of a < before it and there are no more of these.
            pieces = text.replace("<", ">" + _MARK).split(">")
            tags = pieces[1::2] if text.count("<") == len(pieces) // 2 else ()
            read = self.known.get("".join(tags))
            declared = read is not None and tags[0][1:2] == "?"
            outside = pieces[0] + pieces[-1] + (pieces[2] if declared else "")
            pieces.append(None)
            if read is not None and read.pieces == len(pieces) and not outside.strip(" \t\n") and not (declared and pieces[0]):
                if type(read) is _Read:
                    return read, [t or None for t in read.places(pieces)]
                found = None if carried else self._carried(pieces[read.place])
                if found is not None:
                    return found
        document = ET.fromstring(text)
        root = document if carried else unwrap(document)
        elements, is_statement = list(root.iter()), _has_sections(root)
        form = self._form(root, elements)
        read = _Read(form, is_statement, None if form.deep or form.code is None else elements[form.code])
        if tags:
            # An Object without elements carries what its text says, so other texts may be another document.
            objects = [] if root is document else list(document.iter(_SIGNED))
            data = [e for e in objects if not len(e)]
            if not data:
                self._keep(read, tags, pieces, document, elements)
            elif len(data) == 1 and data[0].get("Encoding", "base64").endswith("base64") and not any(_carried(e) for e in objects if e is not data[0]):
                self._keep(read, tags, pieces, document, elements, data[0])
        return read, [*[e.text for e in elements], None]

    def _carried(self, text: str) -> tuple[_Read, list[str | None]] | None:
        """The document that an envelope has as base64, if it can be read as any other."""
        try:
            content = base64.b64decode(text)
            if content.isascii() and content[:1] == b"<" and content[1:2] not in (b"?", b"!"):
                name = re.match(rb"<(?:[^\s:/>]*:)?([^\s/>]*)", content)[1]
                return None if name in (b"Signatures", b"Signature") or content.translate(None, _FINE) else self.read(content, True)
        except (ET.ParseError, ValueError):
            pass
        return None

    def rows(self, doc_id: str, content: bytes, document: tuple | None = None, **more: str | None) -> tuple:
        """A document as _row_batches takes it: element rows and a header row, or one error row. document: it as read, where it has been; more: further facts."""
        try:
            read, texts = self.read(content) if document is None else document
            form = read.form
            if form.deep:
                raise ValueError(f"nested deeper than {MAX_DEPTH} elements")
        except (ET.ParseError, ValueError) as e:
            return _error(doc_id, "parse_error", message=str(e)[:200], **more)
        raw_code = read.raw_code or ("" if form.code is None else texts[form.code] or "")
        facts = {"root_tag": form.root_tag, "raw_code": raw_code}
        for k, places in form.facts:
            found = next((texts[p] for p in places if texts[p]), None)
            facts[k] = None if found is None else found.strip()
        facts |= more
        facts |= form.more
        if not self.nodes:
            return form, doc_id, [(k, v) for k, v in facts.items() if v is not None], form.root_tag, raw_code, facts["period_end"], None, None, None
        a, b, b1 = form.amounts
        return form, doc_id, [(k, v) for k, v in facts.items() if v is not None], form.root_tag, raw_code, facts["period_end"], a(texts)[:-1], b(texts)[:-1], b1(texts)[:-1]


def element_rows(docs: DataFrame, *, id_col: str = "doc_id", content_col: str = "content", staged: bool = True, only_headers: bool = False, fields: Sequence[str] = tuple(_FIELDS)) -> DataFrame:
    """Raw element, header and error rows of each (id, XML), of which an id tells one; written as a table, for several to read.

    a and b are the amounts that count for a node (T2): its own, or those of its last child that has any. is_first: it is the
    first of its section and tag. root_tag, raw_code and period_end are the document's. staged=False: for one reader.
    only_headers: for readers of headers alone, which need no rows of elements. fields: the columns that are asked for.
    """
    workers_import_us(docs.sparkSession)
    schemas = dict(SCHEMAS)  # what is registered here goes to the workers
    fields = [f for f in _FIELDS if f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(schemas, not only_headers)
        yield from _row_batches((reader.rows(doc_id, content or b"") for doc_id, content in _each(batches)), not only_headers, fields, schemas)

    given = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    rows = given.mapInArrow(run, ", ".join(c for c in _ROWS.split(", ") if c.split()[0] in fields))
    return stage(rows, "statement-elements") if staged else rows


def archive_rows(archives: DataFrame, *, path_col: str = "path", content_col: str = "content", staged: bool = True, only_headers: bool = False) -> DataFrame:
    """element_rows of the statement that choose_statements finds in each archive, in one pass; full_name is a fact of the header. An archive without one has an error row with the reason."""
    workers_import_us(archives.sparkSession)
    schemas = dict(SCHEMAS)

    def read(reader: _Reader, path: str, content: bytes | None) -> tuple:
        full_name, _, found, _, reason, document = _pick(content, reader)
        return _error(path, reason) if reason else reader.rows(path, found, document, full_name=full_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(schemas, not only_headers)
        yield from _row_batches((read(reader, path, content) for path, content in _each(batches)), not only_headers, schemas=schemas)

    rows = archives.select(F.col(path_col).cast("string"), content_col).mapInArrow(run, _ROWS)
    return stage(rows, "statement-elements") if staged else rows


def _with_units(rows: DataFrame, code: Column, root_tag: Column) -> DataFrame:
    """rows with _code, _schema and _multiplier: header code, schema and multiplier of a document with the raw code and root tag.

    One is made of the other, column by column, so that a row's code is looked for once and not wherever it is asked for.
    """
    roots = {r: c for c, s in SCHEMAS.items() for r in s["roots"]}
    units = F.create_map(*[F.lit(x) for c, s in SCHEMAS.items() for x in (c, s["multiplier"])])
    rows = rows.withColumn("_code", sc.header_code(F.coalesce(code, F.lit(""))))
    rows = rows.withColumn("_schema", sc.detect_schema(F.col("_code"), F.create_map(*[F.lit(x) for kv in roots.items() for x in kv])[root_tag]))
    return rows.withColumn("_multiplier", sc.unit_multiplier(F.col("_code"), F.coalesce(root_tag, F.lit("")), units[F.col("_schema")]))


def headers(rows: DataFrame, *more: str) -> DataFrame:
    """A row per document with schema, multiplier and company facts; reason_code where it could not be read. more: further facts."""
    f = lambda k: F.col("facts")[k]
    facts = [f(k).alias(k) for k in ("root_tag", "name", "krs", "nip", "pkd", "period_start", "period_end", "date_prepared", "rzis_variant", "cf_method", "reason_code", *more)]
    rows = _with_units(rows.filter("kind <> 'node'"), f("raw_code"), f("root_tag"))
    return rows.select("doc_id", F.col("_schema").alias("schema_code"), F.col("_code").alias("header_code"), F.col("_multiplier").alias("multiplier"), *facts)


def nodes(rows: DataFrame, header: DataFrame | None = None, *more: str) -> DataFrame:
    """Statement nodes with amounts in whole units; a node without own amounts has its last child's.

    header: where multipliers come from, if not from what the rows say of their documents. more: further columns of rows. Of rows without all fields, what they have.
    """
    n = rows.filter("kind = 'node'")
    if header is not None:
        n = n.drop("multiplier").join(header.select("doc_id", "multiplier"), "doc_id")
    times = lambda c, parse: parse(F.col(c)) * F.col("multiplier")
    there = [c for c in ("doc_id", "section", "node_id", "parent_id", "depth", "raw_tag", "tag", "path", "has_amount") if c in n.columns]
    amounts = (("a", sc.parse_amount, "kwota_a"), ("b", sc.parse_amount, "kwota_b"), ("b1", sc.optional_amount, "kwota_b1"))
    return n.select(*there, *[times(c, parse).alias(name) for c, parse, name in amounts if c in n.columns], *more)


def line_items(tree: DataFrame, *more: str) -> DataFrame:
    """T4: one item per document, section and tag, the first in document order. Trees that say which is_first are read in place."""
    section = F.when(F.col("section").isin("aktywa", "pasywa"), "Bilans").when(F.col("section") == "rzis", "RZiS").when(F.col("section") == "cash_flow", "CF").otherwise(F.col("section"))
    first = "is_first" in tree.columns
    rows = (tree.filter("is_first") if first else tree).select("doc_id", section.alias("section"), F.col("tag").alias("tag_path"), F.col("kwota_a").alias("value_current"), *[F.col("kwota_b").alias("value_previous") for c in tree.columns if c == "kwota_b"], *([] if first else ["node_id"]), *more)
    return rows if first else latest(rows, ["doc_id", "section", "tag_path"], [F.asc("node_id")]).drop("node_id")


def flat_values(tree: DataFrame, column: str = "kwota_a") -> DataFrame:
    """T5: a value per document and tag, the last in document order."""
    return tree.groupBy("doc_id", "tag").agg(F.max_by(column, "node_id").alias("value"))


def flat_columns(tree: DataFrame, **columns: str) -> DataFrame:
    """T5 for several amounts in one pass: a new name for each column."""
    return tree.groupBy("doc_id", "tag").agg(*[F.max_by(c, "node_id").alias(n) for n, c in columns.items()])


def _place():
    """What find_value goes by: section (assets, liabilities, profit, cash, extras), then document order."""
    rank = F.when(F.col("section") == "aktywa", 0).when(F.col("section") == "pasywa", 1).when(F.col("section") == "rzis", 2).when(F.col("section") == "cash_flow", 3).otherwise(4)
    return F.struct(rank.alias("r"), F.col("node_id"))


def find_value(tree: DataFrame, tag: str) -> DataFrame:
    """The first value of a tag by section (assets, liabilities, profit, cash, extras), then document order."""
    return tree.filter(F.col("tag") == tag).groupBy("doc_id").agg(F.min_by("kwota_a", _place()).alias("value"))


def find_values(tree: DataFrame, tags: list[str]) -> DataFrame:
    """T6 for several tags in one pass: doc_id, tag, value."""
    return tree.filter(F.col("tag").isin(tags)).groupBy("doc_id", "tag").agg(F.min_by("kwota_a", _place()).alias("value"))


def raw_sections(tree: DataFrame) -> DataFrame:
    """A JSON array of nodes with their parents, in document order, per document and section; balance sheets have both sides."""
    name = F.when(F.col("section").isin("aktywa", "pasywa"), "balance_sheet").when(F.col("section") == "rzis", "income_statement").otherwise(F.col("section"))
    nodes_ = F.collect_list(F.struct("node_id", "parent_id", "depth", "tag", "kwota_a", "kwota_b"))
    return tree.groupBy("doc_id", name.alias("section")).agg(F.to_json(F.sort_array(nodes_)).alias("data_json"))


def _met(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(pair_id, path, previous): what the paths of current meet in previous.

    A top node meets the first node of its tag, wherever that is; a node below the child of its tag under what its
    parent met, the last one if there are several.
    """
    tops = current.filter(~F.col("path").contains("/")).select("pair_id", "tag").distinct()
    met = latest(previous.join(tops, ["pair_id", "tag"]), ["pair_id", "tag"], [F.asc("ord")]).select("pair_id", F.col("tag").alias("_top"), F.col("ord").alias("_ord"), F.col("path").alias("_path"))
    rows = previous.select("pair_id", "path", "ord", "kwota_a").join(met, "pair_id").filter("ord >= _ord")
    below = F.col("path").startswith(F.concat("_path", F.lit("/")))
    rows = rows.withColumn("_end", F.min(F.when((F.col("ord") > F.col("_ord")) & ~below, F.col("ord"))).over(W.partitionBy("pair_id", "_top")))
    rows = rows.filter((F.col("ord") == F.col("_ord")) | (below & (F.col("_end").isNull() | (F.col("ord") < F.col("_end")))))
    rows = rows.select("pair_id", F.substr("path", F.length("_path") - F.length("_top") + 1).alias("path"), "ord", "kwota_a")
    several = F.count(F.lit(1)).over(W.partitionBy("pair_id", "path"))
    last = stage(latest(rows.withColumn("_n", several), ["pair_id", "path"], [F.desc("ord")]), "statements-met")
    # A child of a node that has a later twin has gone with it.
    twins = last.filter("_n > 1").select("pair_id", F.col("path").alias("_twin"), F.col("ord").alias("_at"))
    if twins.isEmpty():
        return last.select("pair_id", "path", F.col("kwota_a").alias("previous"))
    gone = last.join(twins, "pair_id").filter(F.col("path").startswith(F.concat("_twin", F.lit("/"))) & (F.col("ord") < F.col("_at"))).select("pair_id", "path")
    return last.join(gone, ["pair_id", "path"], "left_anti").select("pair_id", "path", F.col("kwota_a").alias("previous"))


def compare(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Current, previous, changes and shares of parent for each node of pair_id.

    For rows that know their paths alone: both have pair_id, path, tag, ord, kwota_a, kwota_b. Without previous, kwota_b counts; with it, see _met. Where
    current repeats a path, its first node is the parent of what is below.
    """
    both = current.withColumn("previous", F.col("kwota_b")) if previous is None else current.join(_met(current, previous), ["pair_id", "path"], "left")
    above = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    up = both.groupBy("pair_id", F.col("path").alias("_above")).agg(F.min_by("kwota_a", "ord").alias("_pa"), F.min_by("previous", "ord").alias("_pp"))
    rows = both.withColumn("_above", above).join(up, ["pair_id", "_above"], "left")
    return rows.select(
        "pair_id", "tag", F.col("kwota_a").alias("current"), "previous", F.round(F.col("kwota_a") - F.col("previous"), 2).alias("change_absolute"), sc.pct_change(F.col("kwota_a"), F.col("previous")).alias("change_percent"),
        sc.share_of_parent(F.col("kwota_a"), F.col("_pa")).alias("share_of_parent_current"), sc.share_of_parent(F.col("previous"), F.col("_pp")).alias("share_of_parent_previous"),
    )


def _matched(keys: np.ndarray, asked: np.ndarray, last: bool = False) -> np.ndarray:
    """For each of asked the first or last place in keys, which are sorted, that equals it, or -1."""
    at = np.searchsorted(keys, asked, "right" if last else "left") - last
    return np.where((at >= 0) & (at < len(keys)) & (keys[np.clip(at, 0, len(keys) - 1)] == asked), at, -1) if len(keys) else np.full(len(asked), -1)


def _below(row: np.ndarray, node: pa.Array, parent: pa.Array) -> np.ndarray:
    """The place of each node's parent among the nodes of its row, or -1."""
    ids, code = np.unique(np.concatenate([node.to_numpy(zero_copy_only=False), parent.fill_null(0).to_numpy(zero_copy_only=False)]), return_inverse=True)
    own, above = row * len(ids) + code[: len(row)], row * len(ids) + code[len(row) :]
    order = np.argsort(own, kind="stable")
    at = _matched(own[order], above)
    return np.where((at >= 0) & parent.is_valid().to_numpy(zero_copy_only=False), order[at] if len(order) else -1, -1)


def _meetings(node: pa.Array, parent: pa.Array, depth: pa.Array, tag: pa.Array, old_node: pa.Array, old_parent: pa.Array, old_tag: pa.Array) -> pa.Array:
    """For each node of each row's tree its parent (up), and the node of the row's other tree that it meets (met), by places in the lists.

    Level by level from the top: a top node meets the first node of its tag, wherever that is; any other the last child of
    its tag under the node that its parent met. All rows of a batch are looked at together, by sorted numbers.
    """
    rows = [np.repeat(np.arange(len(x)), pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)) for x in (node, old_node)]
    starts = [np.searchsorted(r, np.arange(len(node))) for r in rows]
    node, parent, depth, tag, old_node, old_parent, old_tag = (x.flatten() for x in (node, parent, depth, tag, old_node, old_parent, old_tag))
    tags = pa.concat_arrays([tag, old_tag]).dictionary_encode().indices
    code, n = tags.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(node)
    told, tags_n = tags.is_valid().to_numpy(zero_copy_only=False), int(code.max(initial=0)) + 1
    up, old_up = _below(rows[0], node, parent), _below(rows[1], old_node, old_parent)

    def index(keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(some & told[n:])
        order = at[np.lexsort((old_node.to_numpy(zero_copy_only=False)[at], keys[at]))]
        return keys[order], order

    def look(keys: np.ndarray, order: np.ndarray, asked: np.ndarray, last: bool) -> np.ndarray:
        at = _matched(keys, asked, last)
        return np.where(at >= 0, order[at] if len(order) else -1, -1)

    met = np.full(n, -1)
    top = np.flatnonzero(~parent.is_valid().to_numpy(zero_copy_only=False) & told[:n])
    met[top] = look(*index(rows[1] * tags_n + code[n:], np.ones(len(old_node), bool)), rows[0][top] * tags_n + code[top], False)
    below, level, deep = index(old_up * tags_n + code[n:], old_up >= 0), np.zeros(n, bool), depth.fill_null(0).to_numpy(zero_copy_only=False)
    level[top] = met[top] >= 0
    for at in range(1, int(deep.max(initial=0)) + 1):
        some = np.flatnonzero((deep == at) & (up >= 0) & told[:n])
        some = some[level[up[some]]]
        met[some] = look(*below, met[up[some]] * tags_n + code[some], True)
        level = np.zeros(n, bool)
        level[some] = met[some] >= 0
    places = lambda at, start: pa.array((at - start).astype(np.int32), mask=at < 0)
    both = pa.StructArray.from_arrays([places(met, starts[1][rows[0]]), places(up, starts[0][rows[0]])], ["met", "up"])
    return pa.ListArray.from_arrays(pa.array(np.append(starts[0], n).astype(np.int32)), both)


def packed_trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each pair_id with a list of each column's values, those of a node at the same place in all. A tree is of one document, which one row held before."""
    rows = nodes.groupBy("pair_id").agg(F.collect_list(F.struct(*columns)).alias("_n"))
    return rows.select("pair_id", *[F.col(f"_n.{c}").alias(c) for c in columns])


def compare_packed(current: DataFrame, previous: DataFrame, how: str = "inner") -> DataFrame:
    """compare_trees of packed trees: both with node_id, parent_id, tag and kwota_a, current with depth too. A pair's trees meet in one row."""
    workers_import_us(current.sparkSession)
    met = F.arrow_udf(_meetings, "array<struct<met int, up int>>")
    rows = current.join(previous.toDF(*[c if c == "pair_id" else f"_{c}" for c in previous.columns]), "pair_id", how)
    rows = rows.withColumn("_at", met("node_id", "parent_id", "depth", "tag", "_node_id", "_parent_id", "_tag"))
    now, old = lambda at: F.get("kwota_a", at), lambda at: F.get("_kwota_a", at)
    each = F.transform("_at", lambda x, i: F.struct(F.get("tag", i).alias("tag"), now(i).alias("kwota_a"), old(x["met"]).alias("previous"), now(x["up"]).alias("_pa"), old(F.get("_at", x["up"])["met"]).alias("_pp")))
    return _changes(rows.select("pair_id", F.inline(each)))


def compare_trees(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Current, previous, changes and shares of parent for each node of pair_id.

    Both have pair_id, node_id (in document order), parent_id, depth, tag, kwota_a, kwota_b. Without previous, kwota_b counts.
    """
    if previous is not None:
        columns = ("node_id", "parent_id", "tag", "kwota_a")
        return compare_packed(packed_trees(current, *columns, "depth"), packed_trees(previous, *columns), "left")
    both = current.withColumn("previous", F.col("kwota_b"))
    up = both.select("pair_id", F.col("node_id").alias("parent_id"), F.col("kwota_a").alias("_pa"), F.col("previous").alias("_pp"))
    return _changes(both.filter("parent_id is not null").join(up, ["pair_id", "parent_id"], "left").unionByName(both.filter("parent_id is null"), allowMissingColumns=True))


def _changes(rows: DataFrame) -> DataFrame:
    """Changes and shares of rows (pair_id, tag, kwota_a, previous, _pa, _pp): the last two are the parent's amounts."""
    return rows.select(
        "pair_id", "tag", F.col("kwota_a").alias("current"), "previous", F.round(F.col("kwota_a") - F.col("previous"), 2).alias("change_absolute"), sc.pct_change(F.col("kwota_a"), F.col("previous")).alias("change_percent"),
        sc.share_of_parent(F.col("kwota_a"), F.col("_pa")).alias("share_of_parent_current"), sc.share_of_parent(F.col("previous"), F.col("_pp")).alias("share_of_parent_previous"),
    )


def empty_sections(compared: DataFrame, *keys: str) -> DataFrame:
    """Sections without any value on either side."""
    return compared.groupBy(*keys).agg((F.count("current") + F.count("previous") == 0).alias("is_empty"))


def ingest(archives: DataFrame, *, staged: bool = True, only_ledger: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reading part of T7: archives to (nodes, line items, ledger); the ledger has a row per archive.

    Its status is completed or failed, with reason_code unexpected_error, no_xml_found, parse_error or
    invalid_period_end; schema and company facts come with it. Nodes and items are those of completed ones.
    staged=False: one of the three is read, once. only_ledger: nodes and items are not asked for and come back empty.
    """
    rows = archive_rows(archives, staged=staged, only_headers=only_ledger)
    year = sc.fiscal_year(F.col("period_end"))
    reason = F.coalesce("reason_code", F.when(year.isNull(), "invalid_period_end"))
    ledger = headers(rows, "full_name").select(
        F.col("doc_id").alias("path"), F.when(reason.isNull(), "completed").otherwise("failed").alias("status"), reason.alias("reason_code"), "full_name", "schema_code", "name", "krs", "nip", "pkd",
        F.coalesce("period_start", "period_end").alias("period_start"), "period_end", "date_prepared", year.alias("fiscal_year"),
    )
    # What decides on a document is in each of its rows, so nothing is joined.
    tree = nodes(rows.filter(year.isNotNull()), None, "schema_code", "is_first")
    items = line_items(tree, "schema_code")
    return tree.drop("is_first"), items, ledger


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives under a folder as (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
