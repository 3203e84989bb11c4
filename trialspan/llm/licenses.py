r"""Licence recognition by sentences and rules.

A text is normalised and its ends of sentences are marked: hard ones at full stops, blank lines and list marks,
soft ones at line breaks and semicolons. A known licence sentence that stands between two marks gets its
identifier, whatever marks it has inside, so wrapped texts and comment blocks are read like unwrapped ones; a
sentence of the form "... licensed under X" maps to the notice of X. The identifiers in text order, with ``_``
for any other sentence (up to its hard end), are matched against ordered licence rules: fuller licences come first
and take their sentences, so that shorter rules see only what is left. Between two sentences of a rule up to
``GAP`` others may stand. Texts without any word that every known sentence has are answered without cutting them;
that such words exist is checked when the tables are built.

Defined cases: a null text is empty; a text without licence sentences has empty strings and 0; rows that repeat
an id each get a row; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

GAP = 2
CUT = r"[.!?;]+[\x20\x09-\x0D]+|[\x0A\x0D]+"
NOTICE = (r"^(?:(?:this|the|our|all)(?: [a-z]+){1,3} (?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided|"
          r"made available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(.+?)(?: license| licence)?(?: see [a-z ]+)?$")
# the same between marks, with the name's expression; a definition such as (the "License") may follow the name
UNDER = ("(?:(?:this|the|our|all)(?:S[a-z]+){{1,3}}S(?:is|are)S)?(?:dualS)?(?:licensed|released|distributed|available|published|provided|madeSavailable)S"
         "(?:toSyouS)?underS(?:theS)?(?:termsSofS)?(?:theS)?(?:{name})(?:Slicen[cs]e)?(?:StheSlicen[cs]e)?"
         "(?:Ssee(?=S[a-z])(?: [a-z]++)*+(?: /(?: [a-z]++)++(?= [|/]))*+)?").replace("S", "(?: /)? ")
# list marks at the start of a line, and what follows "copyright" inside a sentence
LIST = "[(]?[0-9]{1,2}|[(]?[a-z]|[(][ivx]{1,4}"
INSIDE = "(?:notices?|holders?|owners?|laws?|statements?|licen[cs]es?|and|or|of|in|is|to|by law)[ ]"
# words up to the next mark; loops of unbounded length are possessive, for Java runs others recursively
PIECE = "(?: [^ |/=]++)++"
SPDX = r"^spdx license identifier (.+)$"
CUES = "licen|copyright|warrant|permission|rights reserved|redistribut|public domain|spdx|free software|liab|under "

# fixed values: names of licences as normalised sentences give them
NAMES = {
    "MIT": ["mit", "the mit", "expat", "mit x11"],
    "Apache-2.0": ["apache license version 2 0", "apache 2 0", "apache license 2 0", "apache version 2 0", "apache"],
    "GPL-2.0": ["gnu general public license version 2", "gpl v2", "gplv2", "gpl 2 0", "gnu gpl version 2", "gpl 2 0 only", "gpl 2 0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gpl v3", "gplv3", "gpl 3 0", "gnu gpl version 3", "gnu gpl v3", "gpl 3 0 only",
                "gpl 3 0 or later"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0", "mozilla public 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "bsd"],
    "ISC": ["isc"], "Unlicense": ["unlicense"], "Zlib": ["zlib"], "CC0-1.0": ["cc0", "cc0 1 0", "creative commons zero"],
    **{f"CC-{k}-{v}.0": [f"cc {a} {v} 0", f"cc {a} {v} 0 international", f"creative commons {n} {v} 0", f"creative commons {n} {v} 0 international"]
       for v in "234" for k, a, n in (
           ("BY", "by", "attribution"), ("BY-SA", "by sa", "attribution sharealike"), ("BY-NC", "by nc", "attribution noncommercial"),
           ("BY-ND", "by nd", "attribution noderivatives"), ("BY-NC-SA", "by nc sa", "attribution noncommercial sharealike"),
           ("BY-NC-ND", "by nc nd", "attribution noncommercial noderivatives"))},
}
# fixed values: sentences of public licence texts, normalised
SENTENCES = {
    "all-rights": ["all rights reserved"],
    "mit-head": ["the mit license", "mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
                  "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
                  "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
              "merchantability fitness for a particular purpose and noninfringement"],
    "no-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
                     "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                   "documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                  "this software without specific prior written permission"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                     "without warranties or conditions of any kind either express or implied"],
    "gpl-free2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                  "by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-free3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                  "by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-no-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                        "merchantability or fitness for a particular purpose"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
                  "above copyright notice and this permission notice appear in all copies"],
    "mpl-source": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
# ordered rules: licence, identifiers in order; ``?`` marks one that may be absent
RULES = [
    ("MIT", "mit-head? copyright? all-rights? mit-grant mit-notice as-is? no-liability?"), ("ISC", "copyright? isc-grant as-is?"),
    ("BSD-3-Clause", "copyright? all-rights? bsd-grant bsd-source bsd-binary bsd-names"),
    ("BSD-2-Clause", "copyright? all-rights? bsd-grant bsd-source bsd-binary"),
    ("Apache-2.0", "copyright? notice-Apache-2.0 apache-use apache-copy? apache-as-is?"),
    ("GPL-3.0", "copyright? gpl-free3 gpl-no-warranty?"), ("GPL-2.0", "copyright? gpl-free2 gpl-no-warranty?"),
    ("MPL-2.0", "mpl-source"), ("Unlicense", "unlicense"), ("MIT", "mit-grant"), ("MIT", "mit-head"),
    *[(n, f"copyright? all-rights? notice-{n}") for n in NAMES],
    ("proprietary", "copyright? all-rights"),
]


def tables() -> dict[str, str]:
    """Normalised sentence, or ``@`` and a licence's name, to its identifier."""
    out = {s: i for i, sentences in SENTENCES.items() for s in sentences}
    out |= {f"@{a}": f"notice-{n}" for n, names in NAMES.items() for a in names}
    out |= {f"@{n.lower().replace('-', ' ').replace('.', ' ')}": f"notice-{n}" for n in NAMES}
    unseen = [s for s in out if s[0] != "@" and not any(c in s for c in CUES.split("|"))]
    if unseen:
        raise ValueError(f"sentences without a cue: {unseen}")
    return out


def pattern(rule: str) -> str:
    """Regular expression of a rule over the sequence of identifiers, each after a blank and before another."""
    quoted = lambda i: i.replace("-", "[-]").replace(".", "[.]")
    gap = f"(?: _){{0,{GAP}}}"
    parts, ids = [], rule.split()
    first = next(k for k, i in enumerate(ids) if not i.endswith("?"))
    for k, i in enumerate(ids):
        one = f" {quoted(i.rstrip('?'))}"
        if k < first:
            parts.append(f"(?:{one}{gap})?")
        elif k == first:
            parts.append(one)
        else:
            parts.append(f"(?:{gap}{one})" + ("?" if i.endswith("?") else ""))
    return "".join(parts) + "( |$)"


def marked(text: Column) -> Column:
    """Words with ``|`` at hard and ``/`` at soft ends of sentences, each between blanks; both ends are hard."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[|/=~^]", " "), r"\r\n?", "\n")
    t = F.regexp_replace(t, rf"(?m)^([^a-z0-9\n]*(?:{LIST})[.)])(?=[\x20\x09])", "| $1 |")
    t = F.regexp_replace(t, r"[.!?]+;*[\x20\x09-\x0D]+|;+[.!?]+[\x20\x09-\x0D]+|\n[^a-z0-9\n|]*(?=\n)", " | ")
    t = F.regexp_replace(t, r"\n|;+[\x20\x09-\x0D]+", " / ")
    t = F.regexp_replace(F.concat(F.lit("| "), t, F.lit(" |")), "[^a-z0-9|/]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "/(?: /)++", "/"), "(?:/ )?[|](?: [|/])*+", "|")


def phrase(words: str) -> str:
    """Regular expression of words that may have ends of sentences between them."""
    return words.replace(" ", "(?: [|/])? ")


def identifiers(text: Column) -> Column:
    """Identifiers of the sentences of a text, joined by blanks."""
    found, known = marked(text), {}
    for sentence, i in tables().items():
        known.setdefault((i, sentence[0] == "@"), []).append(sentence.lstrip("@"))
    for (i, name), sentences in known.items():
        if not name:
            some = "|".join(phrase(s) for s in sorted(sentences, key=len, reverse=True))
            found = F.regexp_replace(found, f"([|/]) (?:{some})(?= [|/])", f"$1 ={i}=")
    cue = found.rlike("under |spdx ")
    named = found
    for (i, name), sentences in known.items():
        if name:
            some = "|".join(phrase(s) for s in sorted(sentences, key=len, reverse=True))
            named = F.regexp_replace(named, f"([|/]) (?:{UNDER.format(name=some)}|{phrase('spdx license identifier ')}(?:{some}))(?= [|/])", f"$1 ={i}=")
    found = F.when(cue, named).otherwise(found)
    # a copyright line; after an unfinished sentence only what is none of its usual words
    found = F.regexp_replace(found, r"([|] |= / )copyright [^|/=]+(?= [|/])", "$1=copyright=")
    found = F.regexp_replace(found, rf"(/ )copyright (?!{INSIDE})[^|/=]+(?= [|/])", "$1=copyright=")
    found = F.regexp_replace(found, rf"=copyright=(?: /{PIECE})++(?= [|/])", "=copyright=")
    found = F.regexp_replace(found, rf"([|/]){PIECE}(?: /{PIECE})*+(?= [|/])", "$1 _")
    return F.trim(F.regexp_replace(found, "[ |/=]+", " "))


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, licences and identifiers in text order (comma-joined), n_licences."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.when(text.rlike("(?i)" + CUES.replace(" ", "[^a-z0-9]+")), F.concat(F.lit(" "), identifiers(text))).otherwise("")
    found = F.col("sequence")
    for licence, rule in RULES:
        found = F.regexp_replace(found, pattern(rule), f" ={licence}= ")
    told = F.regexp_extract_all(found, F.lit("=([^ =]+)="), F.lit(1))
    return (docs.select(F.col(id_col).alias("doc_id"), line.alias("sequence"))
            .select("doc_id", told.alias("told"), F.filter(F.split("sequence", " +"), lambda i: ~i.isin("", "_")).alias("ids"))
            .select("doc_id", F.array_join("told", ",").alias("licences"), F.array_join("ids", ",").alias("sentences"),
                    F.size("told").cast("long").alias("n_licences")))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = tables()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = "sequence"
    for licence, rule in RULES:
        found = f"regexp_replace({found}, {q(pattern(rule))}, ' ={licence}= ', 'g')"
    return f"""
with known(s, id) as (values {', '.join(f'({q(a)}, {q(b)})' for a, b in known.items())}),
d as (select doc_id, coalesce(text, '') t from documents),
p as (select doc_id, unnest(string_split_regex(t, {q(CUT)})) s, generate_subscripts(string_split_regex(t, {q(CUT)}), 1) i
  from d where regexp_matches(t, '(?i){CUES}')),
n as (select doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) s from p),
m as (select doc_id, i, coalesce(a.id, b.id, c.id, case when starts_with(n.s, 'copyright ') then 'copyright' end, '_') id
  from n left join known a on a.s = n.s left join known b on b.s = '@' || regexp_extract(n.s, {q(NOTICE)}, 1)
  left join known c on c.s = '@' || regexp_extract(n.s, {q(SPDX)}, 1) where n.s <> ''),
g as (select doc_id, ' ' || string_agg(id, ' ' order by i) as sequence, string_agg(id, ',' order by i) filter (id <> '_') as ids from m group by doc_id),
r as (select doc_id, ids, regexp_extract_all({found}, '=([^ =]+)=', 1) told from g)
select d.doc_id, coalesce(array_to_string(told, ','), '') licences, coalesce(ids, '') sentences, coalesce(len(told), 0)::bigint n_licences
from d left join r using (doc_id)"""


QUERIES = {"op4_license_rules": op4_license_rules}
ORACLES = {"op4_license_rules": _oracle()}
