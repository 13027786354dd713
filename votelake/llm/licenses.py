"""License scans with ordered signature rules, in Spark's own functions only.

Texts become lower-case words joined by single blanks. A rule is a label, a rank, a keyword, a
regular expression over that word string and a confidence. The rules are whole notices and
statements written by hand (`NOTICES`), names without versions (`PLAIN`), and expressions made from
the names and versions of license families (`FAMILIES`, `CREATIVE`). A row is looked at only if it
holds one of the keywords, of which every rule's match contains one; a rule's expression runs only
where its keyword occurs. All matches of a rule count. A detection goes if an earlier-ranked or
equally ranked one covers its interval; of equal intervals the rule that comes first stays.

The scan is one pass over each row: no join, no shuffle; its time is linear in the text (matches
are marked in the word string, whose split gives their word numbers; the sweep keeps its output in
chunks). Null and empty texts have no words, labels or detections, and score 0. Repeated rows get
the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrase and label, counted at every place.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: label, keyword, name as a regular expression, versions in words.
FAMILIES = [
    ("apache", "apache", "apache(?: software)?", ["1 0", "1 1", "2 0", "2"]),
    ("gpl", "general public", "(?:gnu )?general public", ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public", ["2", "2 1", "3", "2 0", "3 0"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2 1", "3", "2 0", "3 0"]),
    ("agpl", "affero", "(?:gnu )?affero general public", ["1", "3", "1 0", "3 0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3", "1 0", "3 0"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public", ["1 0", "2 0"]),
    ("edl", "eclipse", "eclipse distribution", ["1 0"]),
    ("eupl", "european", "european union public", ["1 0", "1 1", "1 2"]),
    ("cddl", "common development", "common development and distribution", ["1 0", "1 1"]),
    ("cpl", "common public", "common public", ["0 5", "1 0"]),
    ("ipl", "ibm", "ibm public", ["1 0"]),
    ("artistic", "artistic", "(?:clarified )?artistic", ["1 0", "2 0"]),
    ("osl", "open software", "open software", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("bsl", "boost", "boost software", ["1 0"]),
    ("busl", "business source", "business source", ["1 0", "1 1"]),
    ("ofl", "open font", "(?:sil )?open font", ["1 0", "1 1"]),
    ("php", "php", "php", ["3 0", "3 01"]),
    ("psf", "python", "python(?: software foundation)?", ["2", "2 0"]),
    ("zpl", "zope", "zope public", ["1 1", "2 0", "2 1"]),
    ("lppl", "latex", "latex project public", ["1 0", "1 2", "1 3"]),
    ("apsl", "apple", "apple public source", ["1 0", "1 1", "1 2", "2 0"]),
    ("npl", "netscape", "netscape public", ["1 0", "1 1"]),
    ("spl", "sun", "sun public", ["1 0"]),
    ("qpl", "q public", "q public", ["1 0"]),
    ("cecill", "cecill", "cecill(?: (?:b|c))?(?: free software)?", ["1 0", "1 1", "2 0", "2 1"]),
    ("ms-pl", "microsoft", "microsoft public", ["1 0"]),
    ("ms-rl", "microsoft", "microsoft reciprocal", ["1 0"]),
    ("upl", "universal permissive", "universal permissive", ["1 0"]),
    ("odbl", "open database", "(?:odc )?open database", ["1 0"]),
    ("odc-by", "attribution", "(?:odc|open data commons) attribution", ["1 0"]),
    ("mulan", "mulan", "mulan (?:permissive software|psl)", ["1", "2"]),
]
#: label, keyword, name: licenses without versions.
PLAIN = [
    ("mit", "mit", "mit"), ("mit", "expat", "expat"), ("bsd", "bsd", "bsd"), ("bsd-2", "bsd", "(?:simplified|2 clause|two clause) bsd"), ("bsd-2", "bsd", "bsd (?:2|two) clause"), ("bsd-3", "bsd", "(?:new|revised|modified|3 clause|three clause) bsd"),
    ("bsd-3", "bsd", "bsd (?:3|three) clause"), ("bsd-4", "bsd", "(?:original|4 clause|four clause) bsd"), ("bsd-4", "bsd", "bsd (?:4|four) clause"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("wtfpl", "what the", "do what the f\\w+ you want to public"), ("unlicense", "unlicense", "unlicense"), ("x11", "x11", "x11"), ("ncsa", "illinois", "(?:university of illinois|uiuc)(?: ncsa)? open source"),
    ("ruby", "ruby", "ruby"), ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"), ("curl", "curl", "curl"), ("vim", "vim", "vim"), ("beerware", "beer", "beer ware"), ("json", "json", "json"), ("w3c", "w3c", "w3c(?: software)?"), ("proprietary", "proprietary", "proprietary"), ("commercial", "commercial", "commercial"), ("royalty-free", "royalty", "royalty free"),
]
CREATIVE = [("by", ""), ("by-sa", " share ?alike"), ("by-nc", " non ?commercial"), ("by-nd", " no deriv(?:ative)?s?(?: works)?"), ("by-nc-sa", " non ?commercial share ?alike"), ("by-nc-nd", " non ?commercial no deriv(?:ative)?s?(?: works)?")]
#: label, rank, keyword, expression, confidence: whole notices and general statements.
NOTICES = [
    ("mit", 1, "permission is", "permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("isc", 1, "permission is", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd", 1, "redistribution", "redistribution and use in source and binary forms with or without modification", 0.98),
    ("cc0", 1, "creative commons", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", 0.95),
    ("cc0", 1, "cc0", "licen[sc]ed under cc0(?: 1 0)?", 0.95),
    ("public-domain", 2, "public domain", "(?:released|placed|dedicated) (?:in|in ?to|to) the public domain", 0.9),
    ("public-domain", 3, "public domain", "public domain licen[sc]e", 0.7),
    ("mit", 1, "above copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("apache-2.0", 1, "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0", 0.98),
    ("apache-2.0", 1, "apache", "www apache org licenses license 2 0", 0.95),
    ("apache", 2, "apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.95),
    ("bsd", 1, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", 1, "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd-3", 1, "endorse or promote", "neither the names? of .{1,80}? may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-4", 1, "all advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("gpl-2.0-or-later", 1, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", 0.98),
    ("gpl-3.0-or-later", 1, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", 0.98),
    ("gpl", 2, "free software", "(?:is free software|it) you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    ("gpl", 2, "general public", "you should have received a copy of the gnu general public license along with", 0.9),
    ("gpl-classpath", 1, "linking", "linking this library statically or dynamically with other modules is making a combined work", 0.95),
    ("lgpl", 1, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.98),
    ("lgpl", 2, "general public", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.9),
    ("agpl", 1, "affero", "under the terms of the gnu affero general public license as published by the free software foundation", 0.98),
    ("agpl", 2, "affero", "you should have received a copy of the gnu affero general public license along with", 0.9),
    ("gfdl", 1, "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.98),
    ("mpl-2.0", 1, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mpl-1.1", 1, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 0.98),
    ("epl", 1, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.98),
    ("cddl", 1, "common development", "the contents of this file are subject to the terms of the common development and distribution license", 0.98),
    ("zlib", 1, "as is", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable", 0.95),
    ("zlib", 1, "altered source", "altered source versions must be plainly marked as such and must not be misrepresented", 0.95),
    ("bsl-1.0", 1, "permission is", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.98),
    ("unlicense", 1, "unencumbered", "this is free and unencumbered software released into the public domain", 0.98),
    ("wtfpl", 1, "what the", "you just do what the f\\w+ you want to", 0.95),
    ("isc", 1, "appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("x11", 1, "x consortium", "the name of the x consortium shall not be used in advertising", 0.95),
    ("ncsa", 1, "deal with", "to deal with the software without restriction including without limitation the rights to use", 0.95),
    ("mit", 1, "deal in", "to deal in the software without restriction including without limitation the rights to use", 0.9),
    ("curl", 1, "permission to use", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that", 0.9),
    ("postgresql", 1, "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("hpnd", 1, "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose", 0.8),
    ("openssl", 1, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("php", 1, "php", "this product includes php(?: software)? freely available from", 0.95),
    ("python", 1, "python", "psf license agreement for python", 0.95),
    ("artistic", 1, "artistic", "under the (?:same )?terms (?:as perl itself|of the artistic license)", 0.9),
    ("perl", 2, "as perl", "under the same terms as perl(?: 5)?(?: itself)?", 0.9),
    ("ofl-1.1", 1, "open font", "this font software is licensed under the sil open font license version 1 1", 0.98),
    ("ofl", 1, "font software", "the font software may be sold as part of a larger software package", 0.9),
    ("lppl", 1, "latex", "this work may be distributed and or modified under the conditions of the latex project public license", 0.98),
    ("json", 1, "not evil", "the software shall be used for good not evil", 0.98),
    ("beerware", 1, "beer", "(?:can|may) buy me a beer in return", 0.95),
    ("vim", 1, "vim", "there are no restrictions on using or copying vim", 0.95),
    ("odbl", 1, "open database", "made available under the open database license", 0.98),
    ("odc-pddl", 1, "open data commons", "open data commons public domain dedication and licen[sc]e", 0.95),
    ("cc", 1, "creative commons", "this (?:work|article|book|document|content|material) is licen[sc]ed under (?:a|the) creative commons", 0.9),
    ("cc-by", 2, "creativecommons", "creativecommons org licenses by [0-9]", 0.9),
    ("cc-by-sa", 2, "creativecommons", "creativecommons org licenses by sa [0-9]", 0.9),
    ("cc-by-nc", 2, "creativecommons", "creativecommons org licenses by nc [0-9]", 0.9),
    ("cc-by-nd", 2, "creativecommons", "creativecommons org licenses by nd [0-9]", 0.9),
    ("cc-by-nc-sa", 2, "creativecommons", "creativecommons org licenses by nc sa [0-9]", 0.9),
    ("cc-by-nc-nd", 2, "creativecommons", "creativecommons org licenses by nc nd [0-9]", 0.9),
    ("cc0", 2, "creativecommons", "creativecommons org publicdomain zero 1 0", 0.95),
    ("cc0", 1, "waived all", "waived all copyright and related or neighbou?ring rights", 0.95),
    ("public-domain", 2, "public domain", "this (?:work|file|code|text|image) is in the public domain", 0.9),
    ("public-domain", 3, "copyright", "no copyright is claimed", 0.6),
    ("bsl-1.1", 1, "change license", "change date .{1,60}? change license", 0.9),
    ("elastic-2.0", 1, "elastic", "elastic license 2 0", 0.95),
    ("sspl-1.0", 1, "server side", "server side public license(?: version 1| v 1)?", 0.95),
    ("commons-clause", 1, "commons clause", "commons clause license condition", 0.95),
    ("oracle-bcl", 1, "binary code", "oracle binary code license agreement", 0.95),
    ("eula", 2, "end user", "end user licen[sc]e agreement", 0.8),
    ("proprietary", 2, "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 0.8),
    ("proprietary", 2, "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) .{0,60}?is strictly prohibited", 0.8),
    ("proprietary", 2, "written permission", "(?:may|must) not be (?:reproduced|copied|redistributed|republished) .{0,60}?without (?:the )?(?:prior |express )?(?:written )?permission", 0.7),
    ("as-is", 3, "as is", "provided as is(?: and)? without (?:any )?(?:express or implied )?warrant(?:y|ies)", 0.6),
    ("copyright", 3, "copyright", "copyright(?: c)?(?: (?:19|20)[0-9]{2})+", 0.7),
    ("copyright", 4, "copyright", "copyright", 0.4),
    ("reserved", 3, "reserved", "(?:all|some|no) rights (?:are )?reserved", 0.7),
    ("as-is", 3, "warranty", "without (?:any )?warranty of any kind", 0.6),
    ("as-is", 3, "warranty", "without even the implied warranty", 0.6),
    ("copyleft", 4, "copyleft", "copyleft", 0.5),
    ("unknown-license", 4, "licen", "licen[sc]ed under", 0.5),
    ("unknown-license", 4, "released under", "released under", 0.4),
    ("unknown-license", 4, "licen", "terms of (?:the|this) [^ ]{1,30} licen[sc]e", 0.5),
    ("unknown-license", 4, "licen", "licen[sc]e agreement", 0.4),
    ("spdx", 2, "spdx", "spdx licen[sc]e identifier [^ ]{1,40}", 0.8),
]
#: Detections that the sweep handles at once.
CHUNK = 256


def rules() -> list[tuple[str, int, str, str, float]]:
    """All rules in order. Expressions match whole words: a blank before, a blank ahead."""
    out = list(NOTICES)
    under = "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?"
    for label, word, name, versions in FAMILIES:
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            said = f"{name}(?: public)?(?: licen[sc]e)?(?: (?:version|v))? {v}"
            out.append((tag, 1, word, under + said, 0.98))
            out.append((tag, 2, word, said, 0.9))
            out.append((tag, 2, "spdx", f"spdx licen[sc]e identifier {label.replace('-', ' ')} {v}(?: only| or later)?", 0.99))
        out.append((label, 3, word, f"{name} licen[sc]e", 0.8))
    for label, word, name in PLAIN:
        out.append((label, 1, word, f"{under}{name} licen[sc]e", 0.95))
        out.append((label, 3, word, f"{name} licen[sc]e", 0.8))
    for kind, words in CREATIVE:
        short = kind.replace("-", " ")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tag = f"cc-{kind}-{v.replace(' ', '.')}"
            out.append((tag, 1, "cc", f"{under}(?:a )?cc {short} {v}", 0.98))
            out.append((tag, 2, "cc", f"cc {short} {v}", 0.9))
            out.append((tag, 1, "creative commons", f"creative commons attribution{words}(?: licen[sc]e)?(?: (?:version|v))? {v}", 0.95))
        out.append((f"cc-{kind}", 3, "cc", f"cc {short}", 0.8))
        out.append((f"cc-{kind}", 3, "creative commons", f"creative commons attribution{words}", 0.8))
    return [(label, rank, whole(word), f" ({p})(?= )", conf) for label, rank, word, p, conf in out]


def whole(word: str) -> str:
    """A keyword as it stands in a word string; one of them is only the beginning of words."""
    return word if word == "licen" else f" {word} "


def gate() -> str:
    """An expression for one of the keywords of which every rule's match holds one; plain names all need the word license."""
    words = {w for _, w, *_ in FAMILIES} | {w for _, _, w, *_ in NOTICES} | {"licen", "spdx", "cc", "creative commons"}
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(whole(w).lstrip()[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def word_string(text: Column) -> Column:
    """The text's words, lower-cased, each with a blank before; a blank at the end."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def detections(words: Column) -> Column:
    """Array of (label, rank, confidence, first and last word): what covers and ranks decide."""
    by_word: dict[str, list[dict]] = {}
    for i, (label, rank, word, p, conf) in enumerate(rules()):
        by_word.setdefault(word, []).append({"label": label, "rank": rank, "p": p, "conf": conf, "i": i})
    table = json.dumps([{"word": w, "rules": r} for w, r in by_word.items()])
    given = F.from_json(F.lit(table), "array<struct<word:string,rules:array<struct<label:string,rank:int,p:string,conf:double,i:int>>>>")
    near = F.flatten(F.transform(F.filter(given, lambda g: F.contains(words, g["word"])), lambda g: g["rules"]))
    hits = F.filter(near, lambda r: F.rlike(words, r["p"]))

    def numbers(tokens: Column, marked) -> Column:
        return F.filter(F.transform(tokens, lambda t, i: F.when(marked(t), i - 1)), lambda i: i.isNotNull())

    def places(r: Column) -> Column:
        marked = F.split(F.regexp_replace(words, r["p"], F.lit(" \x01$1\x02")), " ", -1)

        def both(tokens: Column) -> Column:
            first, last = numbers(tokens, lambda t: F.startswith(t, F.lit("\x01"))), numbers(tokens, lambda t: F.endswith(t, F.lit("\x02")))
            return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (-e).alias("e"), r["rank"].alias("rank"), r["i"].alias("i"), r["label"].alias("label"), r["conf"].alias("conf")))

        return let(marked, both)

    each = F.flatten(F.transform(hits, places))
    kind = "array<struct<label:string,rank:int,confidence:double,s:int,e:int>>"
    ranks = (1, 2, 3, 4)

    def sweep(acc: Column, d: Column) -> Column:
        end = -d["e"]
        covered = reduce(lambda a, b: a | b, [(d["rank"] >= k) & (acc[f"m{k}"] >= end) for k in ranks])
        kept = F.array(F.struct(d["label"].alias("label"), d["rank"].alias("rank"), d["conf"].alias("confidence"), d["s"].alias("s"), end.alias("e")))
        ends = [F.when(d["rank"] == k, F.greatest(acc[f"m{k}"], end)).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in ranks]
        return F.struct(*ends, F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], kept)).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        begin = F.struct(*[acc[f"m{k}"].alias(f"m{k}") for k in ranks], F.array().cast(kind).alias("out"))
        return let(F.aggregate(part, begin, sweep), lambda got: F.struct(*[got[f"m{k}"].alias(f"m{k}") for k in ranks], F.concat(acc["out"], F.array(got["out"])).alias("out")))

    def swept(ordered: Column) -> Column:  # what covers a detection comes before it
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / CHUNK).cast("int")), lambda c: F.slice(ordered, c * CHUNK + 1, CHUNK))
        begin = F.struct(*[F.lit(-1).alias(f"m{k}") for k in ranks], F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(ordered) == 0, F.array().cast(kind)).otherwise(F.aggregate(parts, begin, chunk, lambda acc: F.flatten(acc["out"])))

    return let(F.array_sort(each), swept)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base phrases' places and labels, detections (label, rank, confidence, first and last word), labels and score."""
    rows = docs.select("doc_id", word_string(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", F.when(F.length("w") <= 2, 0).otherwise(blanks(F.col("w")) - 1).cast("long").alias("n_words"), F.rlike("w", F.lit(gate())).alias("gate"))
    none = F.lit(None).cast("array<string>")
    parts = [F.when(F.contains("w", F.lit(f" {p} ")), F.split("w", f" {p}(?= )", -1)).otherwise(none).alias(f"p{i}") for i, (p, _) in enumerate(BASE)]
    kind = "array<struct<label:string,rank:int,confidence:double,s:int,e:int>>"
    rows = rows.select("*", *parts, F.when(F.col("gate"), detections(F.col("w"))).otherwise(F.array().cast(kind)).alias("d"))
    p = [F.col(f"p{i}") for i in range(len(BASE))]
    first = F.least(*[blanks(F.get(x, F.lit(0))) for x in p])
    last = F.greatest(*[F.col("n_words") - (blanks(F.get(x, F.size(x) - 1)) - 1) - len(BASE[i][0].split()) for i, x in enumerate(p)])
    base = F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(BASE[i][1])) for i, x in enumerate(p)]))
    found = F.transform("d", lambda x: F.struct(x["label"].alias("label"), x["rank"].alias("rank"), x["confidence"].alias("confidence"), x["s"].alias("first"), x["e"].alias("last")))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("d", lambda x: x["label"]))))
    score = F.coalesce(F.array_max(F.concat(F.transform("d", lambda x: x["confidence"]), F.transform(base, lambda _: F.lit(0.5)))), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", reduce(lambda a, b: a + b, [F.when(x.isNull(), 0).otherwise(F.size(x) - 1) for x in p]).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.array_sort(base).alias("base_labels"), found.alias("detections"), labels.alias("labels"), score.alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
