"""License detection with ordered signature rules.

A rule is a pattern over a text's words with a keyword that must occur before the pattern is tried.
Rules are ordered by kind (an identifier tag outranks a grant, a grant outranks an address, an
address outranks a name). A detection whose words lie inside those of a kept detection of higher
order is suppressed, so "GNU Lesser General Public License" does not also count as the general one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundline.llm.batches import slices, sums, utf8

# Fixed: phrases that always count, wherever their words stand consecutively.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Order and certainty of the kinds of rule.
KINDS = {"tag": (5, 0.98), "grant": (4, 0.9), "address": (3, 0.85), "title": (2, 0.7), "mention": (1, 0.4)}

# label; keyword; ways to name it in words; identifier tags; addresses (words of the link)
FAMILIES = [
    ("mit", "mit", ["mit license", "mit licence", "expat license"], ["mit"], ["opensource org licenses mit"]),
    ("mit-0", "mit", ["mit no attribution", "mit 0 license"], ["mit 0"], ["opensource org licenses mit 0"]),
    ("apache-2", "apache", ["apache license version 2( 0)?", "apache license 2( 0)?", "apache 2( 0)? licen[sc]e", "apache software license version 2( 0)?"], ["apache 2 0"], ["apache org licenses license 2 0"]),
    ("apache-1.1", "apache", ["apache software license version 1 1", "apache license 1 1"], ["apache 1 1"], ["apache org licenses license 1 1"]),
    ("bsd-2", "bsd", ["(simplified|freebsd|2 clause|two clause) bsd licen[sc]e", "bsd 2 clause( licen[sc]e)?"], ["bsd 2 clause"], ["opensource org licenses bsd 2 clause"]),
    ("bsd-3", "bsd", ["(new|modified|revised|3 clause|three clause) bsd licen[sc]e", "bsd 3 clause( licen[sc]e)?"], ["bsd 3 clause"], ["opensource org licenses bsd 3 clause"]),
    ("bsd-4", "bsd", ["(original|4 clause|four clause) bsd licen[sc]e", "bsd 4 clause( licen[sc]e)?"], ["bsd 4 clause"], []),
    ("bsd-0", "bsd", ["(zero clause|0 clause) bsd licen[sc]e", "0bsd licen[sc]e"], ["0bsd"], ["opensource org licenses 0bsd"]),
    ("bsd", "bsd", ["bsd( style)? licen[sc]e"], [], []),
    ("isc", "isc", ["isc licen[sc]e"], ["isc"], ["opensource org licenses isc"]),
    ("gpl-2", "general public", ["gnu general public licen[sc]e( as published by the free software foundation)?( either)? (version|v) 2( 0)?", "gpl ?v?2( 0)?( or later| only)? licen[sc]e"], ["gpl 2 0( only| or later)?"], ["gnu org licenses( old licenses)? gpl 2 0"]),
    ("gpl-3", "general public", ["gnu general public licen[sc]e( as published by the free software foundation)?( either)? (version|v) 3( 0)?", "gpl ?v?3( 0)?( or later| only)? licen[sc]e"], ["gpl 3 0( only| or later)?"], ["gnu org licenses gpl 3 0"]),
    ("gpl", "general public", ["gnu general public licen[sc]e", "gnu gpl"], [], ["gnu org licenses gpl", "gnu org copyleft gpl"]),
    ("lgpl-2.1", "general public", ["gnu (lesser|library) general public licen[sc]e( as published by the free software foundation)?( either)? (version|v) 2( 1)?"], ["lgpl 2 1( only| or later)?"], ["gnu org licenses( old licenses)? lgpl 2 1"]),
    ("lgpl-3", "general public", ["gnu lesser general public licen[sc]e( as published by the free software foundation)?( either)? (version|v) 3( 0)?"], ["lgpl 3 0( only| or later)?"], ["gnu org licenses lgpl 3 0"]),
    ("lgpl", "general public", ["gnu (lesser|library) general public licen[sc]e"], [], ["gnu org licenses lgpl"]),
    ("agpl-3", "affero", ["gnu affero general public licen[sc]e( (version|v) 3( 0)?)?"], ["agpl 3 0( only| or later)?"], ["gnu org licenses agpl 3 0"]),
    ("fdl", "free documentation", ["gnu free documentation licen[sc]e( version 1 [123])?"], ["gfdl 1 [123]( only| or later)?"], ["gnu org licenses fdl 1 3"]),
    ("mpl-1.1", "mozilla", ["mozilla public licen[sc]e (version |v )?1 1"], ["mpl 1 1"], ["mozilla org mpl 1 1"]),
    ("mpl-2", "mozilla", ["mozilla public licen[sc]e (version |v )?2( 0)?"], ["mpl 2 0"], ["mozilla org mpl 2 0"]),
    ("epl-1", "eclipse", ["eclipse public licen[sc]e (version |v )?1( 0)?"], ["epl 1 0"], ["eclipse org legal epl v10"]),
    ("epl-2", "eclipse", ["eclipse public licen[sc]e (version |v )?2( 0)?"], ["epl 2 0"], ["eclipse org legal epl 2 0", "eclipse org legal epl v20"]),
    ("cddl-1", "common development", ["common development and distribution licen[sc]e( (version )?1( [01])?)?"], ["cddl 1 [01]"], []),
    ("cpl-1", "common public", ["common public licen[sc]e( (version )?1 0)?"], ["cpl 1 0"], []),
    ("eupl", "european union", ["european union public licen[sc]e( (version |v )?1 [012])?"], ["eupl 1 [12]"], []),
    ("artistic-2", "artistic", ["artistic licen[sc]e (version )?2( 0)?"], ["artistic 2 0"], ["opensource org licenses artistic 2 0"]),
    ("artistic-1", "artistic", ["artistic licen[sc]e( 1 0)?"], ["artistic 1 0"], []),
    ("zlib", "zlib", ["zlib( libpng)? licen[sc]e"], ["zlib"], ["opensource org licenses zlib"]),
    ("boost-1", "boost", ["boost software licen[sc]e( version 1 0)?"], ["bsl 1 0"], ["boost org license 1 0"]),
    ("unlicense", "unlicense", ["the unlicense"], ["unlicense"], ["unlicense org"]),
    ("wtfpl", "public license", ["do what the fuck you want to public license"], ["wtfpl"], ["wtfpl net"]),
    ("ofl-1.1", "open font", ["sil open font licen[sc]e( version 1 1)?"], ["ofl 1 1"], ["scripts sil org ofl"]),
    ("python-2", "python", ["python software foundation licen[sc]e( version 2)?"], ["python 2 0", "psf 2 0"], ["docs python org 3 license"]),
    ("ruby", "ruby", ["ruby licen[sc]e"], ["ruby"], []),
    ("php-3", "php", ["php licen[sc]e( version 3 01?)?"], ["php 3 01?"], ["php net license 3 01"]),
    ("openssl", "openssl", ["openssl licen[sc]e"], ["openssl"], []),
    ("postgresql", "postgresql", ["postgresql licen[sc]e"], ["postgresql"], ["opensource org licenses postgresql"]),
    ("ncsa", "illinois", ["university of illinois( ncsa)? open source licen[sc]e"], ["ncsa"], []),
    ("mulan-2", "mulan", ["mulan permissive software licen[sc]e( version 2)?"], ["mulanpsl 2 0"], []),
    ("bsl-1.1", "business source", ["business source licen[sc]e( 1 1)?"], ["busl 1 1"], []),
    ("sspl-1", "server side", ["server side public licen[sc]e( version 1)?"], ["sspl 1 0"], []),
    ("elastic-2", "elastic", ["elastic licen[sc]e( 2 0)?"], ["elastic 2 0"], []),
    ("odbl-1", "open database", ["open (data commons )?(open )?database licen[sc]e( 1 0)?"], ["odbl 1 0"], ["opendatacommons org licenses odbl"]),
    ("odc-by-1", "data commons", ["open data commons attribution licen[sc]e"], ["odc by 1 0"], ["opendatacommons org licenses by"]),
    ("ogl-3", "open government", ["open government licen[sc]e( v?3 0)?"], ["ogl uk 3 0"], []),
    ("cc0", "cc0", ["cc0( 1 0)? universal", "cc0( public domain)? dedication"], ["cc0 1 0"], ["creativecommons org publicdomain zero 1 0"]),
    ("public-domain", "public domain", ["(released|placed|dedicated) (in|into|to) the public domain"], [], ["creativecommons org publicdomain mark 1 0"]),
    ("cc-by", "cc", ["creative commons attribution( [1234] [05])?( international| unported| generic)? licen[sc]e", "cc by [1234] [05]"], ["cc by [1234] [05]"], ["creativecommons org licenses by [1234] [05]"]),
    ("cc-by-sa", "cc", ["creative commons attribution share ?alike( [1234] [05])?( international| unported| generic)?", "cc by sa( [1234] [05])?"], ["cc by sa [1234] [05]"], ["creativecommons org licenses by sa [1234] [05]"]),
    ("cc-by-nd", "cc", ["creative commons attribution no ?deriv(s|atives)( [1234] [05])?", "cc by nd( [1234] [05])?"], ["cc by nd [1234] [05]"], ["creativecommons org licenses by nd [1234] [05]"]),
    ("cc-by-nc", "cc", ["creative commons attribution non ?commercial( [1234] [05])?", "cc by nc( [1234] [05])?"], ["cc by nc [1234] [05]"], ["creativecommons org licenses by nc [1234] [05]"]),
    ("cc-by-nc-sa", "cc", ["creative commons attribution non ?commercial share ?alike( [1234] [05])?", "cc by nc sa( [1234] [05])?"], ["cc by nc sa [1234] [05]"], ["creativecommons org licenses by nc sa [1234] [05]"]),
    ("cc-by-nc-nd", "cc", ["creative commons attribution non ?commercial no ?deriv(s|atives)( [1234] [05])?", "cc by nc nd( [1234] [05])?"], ["cc by nc nd [1234] [05]"], ["creativecommons org licenses by nc nd [1234] [05]"]),
    ("proprietary", "rights", ["all rights reserved"], ["licenseref proprietary"], []),
]

_GRANT = r"(?:(?:is |are )?(?:licen[sc]ed|released|distributed|available|provided|redistribut\w+|covered|published) )?(?:under|subject to|according to)(?: the)?(?: terms of| terms and conditions of| conditions of)?(?: the)? "
_TAG = r"(?:spdx license identifier|licen[sc]e identifier|spdx id|licen[sc]e spdx) "
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHORT = re.compile(rb"cc[^0-9a-z\x80-\xff]+by[^0-9a-z\x80-\xff]")


def needed(body: str) -> list[str]:
    """The parts that every text of a rule's pattern contains: what is optional or has alternatives is left out."""
    return [part for part in re.sub(r"\([^()]*\)\??|\[[^]]*\]\??|.\?", "\n", body).split("\n") if part.strip()]


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: bytes
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[Rule]]:
    """All rules by keyword."""
    table: dict[bytes, list[Rule]] = {}

    def add(label: str, kind: str, keyword: str, body: str) -> None:
        pattern = re.compile(rb"(?<= )(?:" + body.encode() + rb")(?= )")
        table.setdefault(keyword.encode(), []).append(Rule(label, kind, keyword.encode(), pattern))

    for label, usual, names, tags, addresses in FAMILIES:
        for name in names:
            keyword = "gpl" if name.startswith("gpl") or name == "gnu gpl" else "creative" if name.startswith("creative") else usual
            if not any(keyword in part for part in needed(name)):
                keyword = max(needed(name), key=len)
            add(label, "grant", keyword, _GRANT + "(?:" + name + ")")
            add(label, "title", keyword, name)
        for tag in tags:
            add(label, "tag", "identifier", _TAG + "(?:" + tag + ")")
            add(label, "tag", "spdx", _TAG + "(?:" + tag + ")")
            add(label, "mention", "license", "license (?:" + tag + ")")
        for address in addresses:
            add(label, "address", address.split(" ")[0].split("(")[0], "(?:http |https )?(?:www )?(?:" + address + ")")
    return table


@lru_cache(maxsize=1)
def anchors() -> tuple[bytes, ...]:
    """Parts of single words; a text to which a rule or base phrase applies holds one of them or ``_SHORT``.

    Every tag of a rule stands behind one of the first two.
    """
    found = ["licen", "spdx"]
    for body in [*BASE_PHRASES, *(body for _, _, names, _, addresses in FAMILIES for body in (*names, *addresses))]:
        parts = needed(body)
        if not any("cc by " in f"{part} " for part in parts) and not any(a in part for a in found for part in parts):
            found.append(max((word for part in parts for word in part.split()), key=len))
    return tuple(a.encode() for a in found)


class Detection(NamedTuple):
    first: int
    last: int
    order: int
    label: str
    kind: str


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that do not lie inside a kept one of the same or a higher order.

    A tree over the first words holds the furthest last word of the kept detections that begin no
    later, so a text with very many detections takes n log n steps.
    """
    kept: list[Detection] = []
    place = {first: i + 1 for i, first in enumerate(sorted({d.first for d in found}))}
    furthest = [-1] * (len(place) + 1)
    for one in sorted(set(found), key=lambda d: (-d.order, d.first - d.last, d.first, d.label)):
        at, reach = place[one.first], -1
        while at:
            reach = max(reach, furthest[at])
            at &= at - 1
        if reach >= one.last:
            continue
        kept.append(one)
        at = place[one.first]
        while at < len(furthest):
            furthest[at] = max(furthest[at], one.last)
            at += at & -at
    return kept


def scan(text: bytes) -> tuple[list[tuple[int, str]], list[Detection]]:
    """Base places (first word, label) and resolved detections of a text whose A-Z are lower-cased."""
    if not (any(a in text for a in anchors()) or (b"cc" in text and _SHORT.search(text))):
        return [], []
    spaced = b" " + b" ".join(_WORD.findall(text)) + b" "
    # word i stands behind the i-th blank
    blanks = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    base: list[tuple[int, str]] = []
    for phrase, label in BASE_PHRASES.items():
        needle = f" {phrase} ".encode()
        at = spaced.find(needle)
        while at >= 0:
            base.append((int(np.searchsorted(blanks, at)), label))
            at = spaced.find(needle, at + 1)
    found = []
    for keyword, group in rules().items():
        if keyword not in spaced:
            continue
        for rule in group:
            for match in rule.pattern.finditer(spaced):
                first = int(np.searchsorted(blanks, match.start())) - 1
                last = first + match.group().count(b" ")
                found.append(Detection(first, last, KINDS[rule.kind][0], rule.label, rule.kind))
    return base, resolve(found)


_LOWER = bytes(range(256)).lower()
_IS_WORD = np.zeros(256, np.int8)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: counts, places, labels and every detection.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.
    A null or empty text has no words and no labels (empty strings), score 0 and null places. Null
    ids and repeated rows are answered row by row; other columns are not read.
    """
    chosen = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", chosen.schema["doc_id"].dataType),
            *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("detections", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]))),
        ]
    )
    spans = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = utf8(batch.column("text"))
            inside = _IS_WORD[data]
            begins = inside.copy()
            begins[1:] &= 1 - inside[:-1]
            edge = bounds[:-1][np.diff(bounds) > 0]
            begins[edge] = inside[edge]
            lowered = data.tobytes().translate(_LOWER)
            rows = {name: [] for name in schema.names[2:]}
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                base, kept = scan(lowered[start:end])
                doubt = 1.0
                for one in kept:
                    doubt *= 1 - KINDS[one.kind][1]
                for _ in base if not kept else ():
                    doubt *= 1 - KINDS["title"][1]
                rows["n_base"].append(len(base))
                rows["first_word"].append(min(base)[0] if base else None)
                rows["last_word"].append(max(base)[0] if base else None)
                rows["base_labels"].append(",".join(sorted({b[1] for b in base})))
                rows["labels"].append(",".join(sorted({b[1] for b in base} | {k.label for k in kept})))
                rows["score"].append(1 - doubt)
                rows["detections"].append([{"label": k.label, "kind": k.kind, "first_word": k.first, "last_word": k.last} for k in sorted(kept)])
            arrays = [batch.column("doc_id"), pa.array(sums(begins, bounds), pa.int64())]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), spans]
            arrays += [pa.array(rows[name], kind) for name, kind in zip(schema.names[2:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return chosen.mapInArrow(detect, schema)
