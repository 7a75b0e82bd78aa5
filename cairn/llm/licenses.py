"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than a-z and
0-9 made one space, `licence` spelt with s, lead phrases such as "this work is released under the
terms of the" made `under`), and looked up in a table of known licence sentences.  The identifiers
found, in text order, are then matched against ordered rules: a rule holds when its identifiers occur
in its order, with others between them or not.  All of it is one projection: no join, no shuffle.

Texts without any of a few words, of which every known sentence has at least one, are passed over early.  A null or empty
text has no sentences and no licence.  Sentences end at . ! ? ; : before white space, at a line's end
after another character than a letter, digit, comma, quote or bracket, at empty lines, and before
lines that start like a licence sentence.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read

# Names by which texts refer to licences, as normalised words.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gpl version 2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gpl version 3", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl version 3"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
}

# Sentences of licence texts and notices, as normalised words.
SENTENCES = {
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "mit-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl-free": ["this program is free software"],
    "gpl-2-or-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-3-or-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "public-domain": ["this work is in the public domain", "released into the public domain"],
    "all-rights-reserved": ["all rights reserved"],
}

# Ordered rules, the most complete first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-use", "apache-obtain", "apache-see"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-or-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-or-later"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["all-rights-reserved"]),
]
#: A rule that holds hides the rules it implies.
HIDES = {"BSD-3-Clause": ["BSD-2-Clause"]}


def _creative_commons() -> dict[str, list[str]]:
    out = {}
    long = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    for kind in ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa"):
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            full = " ".join(long[x] for x in kind.split())
            name = f"CC-{kind.replace(' ', '-').upper()}-{version.replace(' ', '.')}"
            out[name] = [f"cc {kind} {version}", f"cc {kind} {version} license", f"creative commons {full} {version} international license", f"creative commons {full} {version} license"]
    return out


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; references to a licence by name are `ref-<licence>`."""
    refs = {f"under {w}": f"ref-{name}" for name, words in {**NAMES, **_creative_commons()}.items() for w in words}
    own = {w: i for i, words in SENTENCES.items() for w in words}
    return {**refs, **own}


def rules() -> list[tuple[str, list[str]]]:
    return RULES + [(name, [f"ref-{name}"]) for name in (*NAMES, *_creative_commons())]


def anchor_words() -> list[str]:
    """Words such that every known sentence has one of them, each the word of five letters or more that most of the sentences left have."""
    left, out = [set(s.split()) for s in known_sentences()], []
    while left:
        count = Counter(w for words in left for w in words)
        out.append(min(count, key=lambda w: (len(w) < 5, -count[w], -len(w), w)))
        left = [words for words in left if out[-1] not in words]
    return out


def anchor() -> str:
    """Matches every lower-case text with a known sentence: LEAD leaves `under` in, so all words of it are in the text."""
    return "|".join(w.replace("license", "licen[cs]e") for w in anchor_words())


# Patterns that Java's and RE2's regular expressions read alike.
BREAK_AFTER = r"([.!?;:])[ \t\r\n]+"
BREAK_LINE = r"([^\p{L}\p{N},\"'()])\r?\n"
BREAK_EMPTY = r"\n[ \t\r]*\n"
BREAK_BEFORE = r"\n((?:Licensed|Released|This |All rights|Copyright|Permission|Redistribution|Neither|Distributed|You may|Unless|THE SOFTWARE|THIS SOFTWARE))"
LEAD = (
    r"^(this [a-z]+ is |this is |you may use this [a-z]+ |it is )?(dual |also )?(licensed|released|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?"
)
MARK = "\u0001"


def _sentences(text: Column) -> Column:
    s = F.regexp_replace(text, BREAK_AFTER, f"$1{MARK}")
    s = F.regexp_replace(s, BREAK_LINE, f"$1{MARK}")
    s = F.regexp_replace(s, BREAK_EMPTY, MARK)
    return F.split(F.regexp_replace(s, BREAK_BEFORE, f"{MARK}$1"), MARK)


def _normal(sentence: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.replace(s, F.lit("licence"), F.lit("license")), LEAD, "under ")


def _rule_pattern(ids: list[str]) -> str:
    return " " + " (?:[^ ]+ )*".join(i.replace(".", "[.]") for i in ids) + " "


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (known sentences in text order, space-separated) and licenses (sorted, comma-separated).

    Both are empty where nothing is known; columns of these names in docs are replaced.
    """
    table = F.create_map(*[F.lit(x) for pair in sorted(known_sentences().items()) for x in pair])
    source = F.col(text).cast("string")
    ids = F.filter(F.transform(_sentences(source), lambda s: table[_normal(s)]), lambda i: i.isNotNull())
    found = F.when(F.coalesce(F.lower(source).rlike(anchor()), F.lit(False)), F.array_join(ids, " ")).otherwise(F.lit(""))
    out = docs.withColumn("sentence_ids", found)
    padded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    hit = {}
    for name, ids_of in rules():
        hit.setdefault(name, []).append(padded.rlike(_rule_pattern(ids_of)))
    holds = {name: _any(tests) for name, tests in hit.items()}
    shown = {name: test & ~_any([holds[h] for h, hidden in HIDES.items() if name in hidden]) for name, test in holds.items()}
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in sorted(shown.items())]))
    return out.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(names, ",")))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sentence_ids", "licenses")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan in DuckDB SQL; it looks at every text, without the words by which the query passes over some."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(known_sentences().items()))
    pattern = ", ".join(f"({_quoted(name)}, {_quoted(_rule_pattern(ids))})" for name, ids in rules())
    hides = ", ".join(f"({_quoted(h)}, {_quoted(n)})" for h, ns in HIDES.items() for n in ns)
    s = f"regexp_replace(text, {_quoted(BREAK_AFTER)}, '\\1' || chr(1), 'g')"
    s = f"regexp_replace({s}, {_quoted(BREAK_LINE)}, '\\1' || chr(1), 'g')"
    s = f"regexp_replace({s}, {_quoted(BREAK_EMPTY)}, chr(1), 'g')"
    s = f"regexp_replace({s}, {_quoted(BREAK_BEFORE)}, chr(1) || '\\1', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rule(license, pattern) AS (VALUES {pattern}), hides(shown_by, license) AS (VALUES {hides}),
cut AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split({s}, chr(1)) AS parts FROM documents)),
norm AS (SELECT doc_id, pos, regexp_replace(replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license'), {_quoted(LEAD)}, 'under ') AS sentence FROM cut),
seq AS (SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM norm JOIN known USING (sentence) GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id, license FROM seq JOIN rule ON regexp_matches(' ' || ids || ' ', pattern)),
shown AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hides x JOIN hit y ON y.license = x.shown_by WHERE x.license = h.license AND y.doc_id = h.doc_id)),
named AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(seq.ids, '') AS sentence_ids, coalesce(named.licenses, '') AS licenses
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN named USING (doc_id)"""
