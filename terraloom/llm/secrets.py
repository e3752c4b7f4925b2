"""Secret scans by multipart credential linking.

Base spans come from three fixed patterns.  On top of them every text is
searched for weak parts: identifiers (``user=``, ``client_id:`` ...), secret
values (long tokens of mixed letters and digits; values of any length assigned
to ``password``, ``pwd``, ``pass``, ``secret``, ``key`` ...) and endpoints
(URLs, hosts, addresses with a port, values assigned to ``host`` and the
like).  A weak part alone says nothing; the parts of a text are joined by their
intervals inside a scope (a paragraph, and at most ``window`` code points
between two parts).  A weak secret is reported only if an identifier and an
endpoint stand in the same scope, two different parts; a base access key may be
one of them, but not both.  An assigned secret is also reported if an
identifier is assigned right beside it, with nothing but separators between.

Null texts count as empty.  Empty texts give zero counts, the digest of the
empty string and an empty ``spans``.  Rows are independent: repeated rows give
repeated results, other columns of the input are ignored, whatever their names.
The whole text is scanned, however long it is; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm.common import table

#: Fixed by the contract of the query: kinds in this order.
BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("linked_id", "linked_secret", "linked_endpoint")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + LINKED_KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run is taken whole by the greedy base pattern, so asking for its least length at once finds the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

WEAK_ID = re.compile(r"""(?:\b|(?<=_))(?:user(?:name|_?id)?|uid|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", re.I | re.A)
ASSIGNED = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|(?:\b|(?<=_))(?:pass|key)|(?:access|account|auth|private|secret|shared|signing)key)\d*["']?\x20*(?:=>|:=|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;&]+))""", re.I | re.A
)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9/+_=-])[A-Za-z0-9/+_-]{20,}={0,2}(?![A-Za-z0-9/+_=-])", re.A)
AFTER_SCHEME = re.compile(r"://[A-Za-z0-9._~:@-]+")
SCHEME = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}\Z", re.A)
ADDRESS = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b", re.A)
#: Names are taken whole, so that none is read twice; what makes one an endpoint is tested then.
NAMES = re.compile(r"(?<![\w.-])[a-z0-9-][a-z0-9.-]*+", re.A)
INNER = (".amazonaws.com", ".internal", ".local")
INNER_NAME = re.compile(r"(.*[a-z0-9-](?:\.amazonaws\.com|\.internal|\.local))(?![\w-])", re.A | re.S)
HOST = re.compile(r"(.*[a-z0-9-]\.(?:amazonaws\.com|internal|local))(?![\w-])", re.A | re.S)
HOST = re.compile(r"""(?:\b|(?<=_))(?:host(?:_?name)?|server|endpoint|domain|addr(?:ess)?|data_?source)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*(?::\d{1,5})?)""", re.I | re.A)
URL = re.compile(r"[a-z][a-z0-9+.-]*://", re.I | re.A)
BESIDE = re.compile(r"""[\s"',;&|(){}\[\]]*""")
NAME = re.compile(r"\w{0,40}", re.A)
SCOPE_END = re.compile(r"\n\s*\n")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind, without those that fail their condition."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _mixed(token: str) -> bool:
    """Three character classes and many changes of class: unlike a word or a path."""
    classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in token)
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    return len(set(classes) - {"s"}) == 3 and changes >= len(token) // 5


def _two_class(token: str) -> bool:
    """Digits and letters of one case that change often, as in a UUID or base32: unlike a word, a path or a date."""
    classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" for c in token if c.isalnum())
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    return len(set(classes)) == 2 and "d" in classes and "/" not in token and changes >= max(3, len(classes) // 8)


class _Near:
    """Sorted intervals; tells if one lies within ``window`` of another interval."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        reach: list[int] = []
        for _, e in self.spans:
            reach.append(max(e, reach[-1]) if reach else e)
        self.reach = reach

    def close(self, start: int, end: int, window: int) -> bool:
        last = bisect_right(self.starts, end + window)
        return last > 0 and self.reach[last - 1] >= start - window


def _endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, addresses with a port, and names of inner hosts."""
    out = []
    if "://" in text:
        for m in AFTER_SCHEME.finditer(text):
            left = max(0, m.start() - 17)
            if scheme := SCHEME.search(text[left : m.start()]):
                out.append((left + scheme.start(), m.end()))
    if ":" in text:
        out += [m.span() for m in ADDRESS.finditer(text)]
    if any(x in text for x in INNER):
        urls = _Near(out)
        for m in NAMES.finditer(text):
            if "." in m[0] and (host := INNER_NAME.match(m[0])):
                span = m.start() + len(host[1]) - len(host[1].lstrip(".-")), m.start() + host.end(1)
                if not urls.close(*span, -1):
                    out.append(span)
    return out


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> tuple[dict[tuple[int, int], bool], list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Weak secrets (and whether an identifier is assigned right beside each), identifiers and endpoints; None without secrets or identifiers."""
    tokens = [(m.start(), m.end(), _mixed(m[0])) for m in WEAK_SECRET.finditer(text) if _mixed(m[0]) or _two_class(m[0])]
    assigned = {m.span(m.lastindex): m.start() for m in ASSIGNED.finditer(text) if not URL.match(m[m.lastindex])} if "=" in text or ":" in text else {}
    if not tokens and not assigned:
        return None
    ids = [(m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    if not ids and not any(k == "access" for *_, k in base):
        return None
    ends = _endpoints(text)
    hosts, urls = [(m.start(), m.end()) for m in HOST.finditer(text)], _Near(ends)
    ends += [s for s in hosts if not urls.close(*s, -1)]
    # the value of an identifier or a part of an endpoint is no two-class secret, and an assigned value is reported once
    other, values = _Near(ids + ends), _Near(list(assigned))
    starts, stops = {s for s, _ in ids}, {e for _, e in ids}

    def beside(span: tuple[int, int]) -> bool:
        """An identifier is assigned right before or right after an assigned secret."""
        at = BESIDE.match(text, span[1]).end()
        name = NAME.match(text, at).end()  # the identifier may have a prefix, as in DB_USER
        if any(i in starts for i in range(at, name + 1)) and not SCOPE_END.search(text, span[1], at):
            return True
        first = assigned[span]
        while first and (text[first - 1].isalnum() or text[first - 1] == "_"):
            first -= 1
        end = first
        while end and end not in stops and BESIDE.fullmatch(text[end - 1]):
            end -= 1
        return end in stops and not SCOPE_END.search(text, end, first)

    secrets = {(s, e): False for s, e, strong in tokens if not values.close(s, e, -1) and (strong or not other.close(s, e, -1))}
    secrets |= {span: beside(span) for span in assigned}
    return secrets, ids, ends


def linked_spans(text: str, base: list[tuple[int, int, str]], window: int) -> list[tuple[int, int, str]]:
    """Weak parts whose complements co-occur in their scope; base spans are never repeated."""
    parts = weak_parts(text, base)
    if parts is None:
        return []
    secrets, ids, ends = parts
    named = _Near(ids)
    # an access key that an identifier's pattern has found too is one part
    access = [(s, e) for s, e, k in base if k == "access" and not named.close(s, e, -1)]
    taken = _Near([(s, e) for s, e, _ in base])
    breaks = [m.start() for m in SCOPE_END.finditer(text)]
    by_scope: dict[int, tuple[list, list, list, list]] = {}
    for slot, spans in enumerate((secrets, ids, ends, access)):
        for s in spans:
            by_scope.setdefault(bisect_left(breaks, s[0]), ([], [], [], []))[slot].append(s)
    out = []
    for found, who, where, keys in by_scope.values():
        near_id, near_end, near_key = _Near(who), _Near(where), _Near(keys)
        kept = []
        for s in found:
            complements = near_id.close(*s, window) + near_end.close(*s, window) + near_key.close(*s, window)
            if (complements > 1 or (secrets[s] and near_id.close(*s, window))) and not taken.close(*s, -1):
                kept.append(s)
        if kept:
            near_kept = _Near(kept)
            out += [(*s, "linked_secret") for s in kept]
            out += [(*s, "linked_id") for s in who if near_kept.close(*s, window)]
            out += [(*s, "linked_endpoint") for s in where if near_kept.close(*s, window)]
    return out


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every secret span (endpoints and identifiers stay) replaced by ``mark``."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if k in ("linked_id", "linked_endpoint") or e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_spans(text: str, window: int = 200) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in order of start and kind."""
    base = base_spans(text)
    extra = linked_spans(text, base, window)
    return base, sorted(base + extra, key=lambda s: (s[0], ORDER[s[2]], s[1])) if extra else base


def scan_text(text: str | None, window: int = 200, with_text: bool = True) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256, spans, redacted) of one text; ``redacted`` is null unless asked for."""
    text = text or ""
    base, spans = find_spans(text, window)
    kinds = [k for _, _, k in base]
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return (*(kinds.count(k) for k in BASE_KINDS), digest, _joined(spans), (redact(text, spans) if spans else text) if with_text else None)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, with_text: bool = False) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans.

    ``with_text`` adds the text with its secrets replaced, as ``redacted``.
    """
    schema = SCHEMA if with_text else SCHEMA.rpartition(",")[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, window, with_text) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) or [[]] * 6
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5])]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if with_text:
                arrays, names = [*arrays, pa.array(cols[5], pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(scan, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", window: int = 200) -> DataFrame:
    """The rows of ``docs`` with the secrets in their texts replaced, all columns in their order; null and empty texts stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            texts = [None if not t.is_valid else redact(text, spans) if (spans := find_spans(text := t.as_py(), window)[1]) else text for t in column]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return docs.mapInArrow(clean, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
