"""License scan: ordered signature rules, gated by keywords, with priorities and interval containment.

A text becomes its words in lower case with one space around each, so a signature is a regular expression over
words and a place is a word number. A rule runs only where its keyword stands among the text's words, and no rule
runs where a cheap test of the raw text shows that no expression can match; that test is made from the expressions. A detection inside another detection of
the same or a higher priority is suppressed: "apache license" inside "licensed under the apache license version 2 0".

Finding is expressions over one row, in which every word carries its number. Only detections of rows that have several are
shuffled: running maxima in a window over a row's detections say which others hold each of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import write_through

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII but letters and digits parts words, in any case.
PARTING = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# The phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# License names as word signatures, each with its keyword and label. A version is a group of digits.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("gnu", "gnu general public license", "gpl"), ("gnu", "gnu lesser general public license", "lgpl"), ("gnu", "gnu library general public license", "lgpl"),
    ("gnu", "gnu affero general public license", "agpl"), ("gnu", "gnu free documentation license", "gfdl"), ("gpl", "gpl", "gpl"), ("lgpl", "lgpl", "lgpl"),
    ("agpl", "agpl", "agpl"), ("gfdl", "gfdl", "gfdl"), ("apache", "apache(?: software)? license", "apache"), ("mit", "mit license", "mit"), ("expat", "expat license", "mit"),
    ("bsd", "(?:[234] clause )?(?:simplified |modified |new |original )?bsd(?: [234] clause)?(?: license)?", "bsd"), ("isc", "isc license", "isc"),
    ("mozilla", "mozilla public license", "mpl"), ("mpl", "mpl", "mpl"), ("eclipse", "eclipse public license", "epl"), ("eclipse", "eclipse distribution license", "edl"),
    ("artistic", "artistic license", "artistic"), ("boost", "boost software license", "bsl"), ("zlib", "zlib(?: libpng)? license", "zlib"),
    ("unlicense", "(?:the )?unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("european", "european union public licen[cs]e", "eupl"), ("eupl", "eupl", "eupl"),
    ("cddl", "cddl", "cddl"), ("common", "common development and distribution license", "cddl"), ("common", "common public license", "cpl"),
    ("python", "python(?: software foundation)? license", "python"), ("php", "php license", "php"), ("ruby", "ruby license", "ruby"), ("postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl license", "openssl"), ("academic", "academic free license", "afl"), ("open", "open software license", "osl"), ("open", "open database license", "odbl"),
    ("odbl", "odbl", "odbl"), ("sil", "sil open font license", "ofl"), ("font", "open font license", "ofl"), ("microsoft", "microsoft public license", "ms-pl"),
    ("microsoft", "microsoft reciprocal license", "ms-rl"), ("creative", "creative commons(?: license)?", "cc"), ("business", "business source license", "busl"),
    ("elastic", "elastic license", "elastic"), ("server", "server side public license", "sspl"), ("sspl", "sspl", "sspl"), ("q", "q public license", "qpl"),
    ("ibm", "ibm public license", "ipl"), ("intel", "intel open source license", "intel"), ("w3c", "w3c(?: software)?(?: notice and)? license", "w3c"),
    ("upl", "upl", "upl"), ("universal", "universal permissive license", "upl"), ("ncsa", "(?:university of illinois )?ncsa(?: open source)? license", "ncsa"),
    ("latex", "latex project public license", "lppl"), ("lppl", "lppl", "lppl"), ("mulan", "mulan (?:permissive|public) software license", "mulan"),
    ("cecill", "cecill(?: [abc])?(?: license)?", "cecill"), ("beerware", "beerware license", "beerware"), ("sleepycat", "sleepycat license", "sleepycat"),
    ("vim", "vim license", "vim"), ("zope", "zope public license", "zpl"), ("sun", "sun public license", "spl"), ("nokia", "nokia open source license", "nokia"),
    ("apple", "apple public source license", "apsl"), ("community", "community data license agreement", "cdla"), ("polyform", "polyform [a-z]+(?: license)?", "polyform"),
)
#: How a name stands: priority, expression around it, and whether a version behind it becomes part of the label.
SHAPES: tuple[tuple[int, str, bool], ...] = (
    (3, "(?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?(?:the )?{name}(?: (?:version |v)?([0-9]+(?: [0-9]+)?))?(?: or (?:any )?later(?: version)?)?", True),
    (3, "(?:subject to|governed by|in accordance with|in compliance with|compliance with) (?:the )?(?:terms of )?(?:the )?{name}(?: (?:version |v)?([0-9]+(?: [0-9]+)?))?", True),
    (2, "{name} (?:version |v)([0-9]+(?: [0-9]+)?)(?: or (?:any )?later(?: version)?)?", True),
    (1, "{name}", False),
)
# Signatures of their own, with keyword, label and priority; a group, if any, is joined to the label.
NOTICES: tuple[tuple[str, str, str, int], ...] = (
    ("spdx", "spdx license identifier ([a-z]+(?: [a-z0-9]+)?(?: [0-9]+)?)", "spdx", 4),
    ("cc", "cc (by(?: nc)?(?: sa| nd)?(?: [1-4] [0-9])?)", "cc", 2), ("cc", "cc (?:0|zero)", "cc0", 2), ("cc0", "cc0(?: 1 0)?", "cc0", 2),
    ("creative", "creative commons (attribution(?: non ?commercial)?(?: share ?alike| no ?deriv(?:ative)?s(?: works)?)?)", "cc", 2),
    ("rights", "all rights reserved", "all-rights-reserved", 2), ("reserved", "rights reserved", "all-rights-reserved", 1),
    ("domain", "public domain", "public-domain", 1), ("domain", "(?:released|dedicated|placed|put) (?:in)?to the public domain", "public-domain", 3),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", "copyright", 1), ("copyleft", "copyleft", "copyleft", 1),
    ("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 3),
    ("permission", "permission to use copy modify and or distribute this software", "isc", 3),
    ("redistribution", "redistribution and use in source and binary forms", "bsd", 3),
    ("warranty", "without warranty of any kind", "no-warranty", 1), ("terms", "terms of use", "terms-of-use", 1),
    ("droits", "tous droits r[ée]serv[ée]s", "all-rights-reserved", 2), ("derechos", "todos los derechos reservados", "all-rights-reserved", 2),
    ("rechte", "alle rechte vorbehalten", "all-rights-reserved", 2), ("gemeinfrei", "gemeinfrei", "public-domain", 1),
    ("domaine", "domaine public", "public-domain", 1), ("dominio", "dominio p[úu]blico", "public-domain", 1),
    ("proprietary", "proprietary and confidential", "proprietary", 2), ("free", "free for (?:non ?commercial|personal) use", "non-commercial", 1),
)
# Sentences that only the text of a license has, with keyword and label.
SENTENCES: tuple[tuple[str, str, str], ...] = (
    ("sublicense", "to use copy modify merge publish distribute sublicense and or sell copies", "mit"),
    ("substantial", "shall be included in all copies or substantial portions of the software", "mit"),
    ("noninfringement", "merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("hereby", "permission is hereby granted without written agreement and without license or royalty fees", "mit"),
    ("retain", "redistributions of source code must retain the above copyright notice this list of conditions", "bsd"),
    ("redistributions", "redistributions in binary form must reproduce the above copyright notice", "bsd"),
    ("endorse", "may be used to endorse or promote products derived from this software", "bsd"),
    ("advertising", "all advertising materials mentioning features or use of this software must display", "bsd"),
    ("contributors", "provided by the copyright holders and contributors as is", "bsd"),
    ("regents", "the regents of the university of california", "bsd"),
    ("isc", "the software is provided as is and isc disclaims all warranties", "isc"),
    ("disclaims", "the author disclaims all warranties with regard to this software", "isc"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org", "apache"),
    ("contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "apache"),
    ("notices", "derivative works a copy of this license and you must cause any modified files to carry prominent notices", "apache"),
    ("gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("gnu", "you should have received a copy of the gnu (?:lesser |affero |library )?general public license along with", "gpl"),
    ("redistribute", "this library is free software you can redistribute it and or modify it", "lgpl"),
    ("freedom", "intended to guarantee your freedom to share and change", "gpl"),
    ("copyleft", "is a free copyleft license for software and other kinds of works", "gpl"),
    ("network", "interacting with it remotely through a computer network", "agpl"),
    ("invariant", "with no invariant sections no front cover texts and no back cover texts", "gfdl"),
    ("mozilla", "this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("mpl", "if a copy of the mpl was not distributed with this file", "mpl"),
    ("eclipse", "the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "epl"),
    ("organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl"),
    ("misrepresented", "the origin of this software must not be misrepresented", "zlib"),
    ("altered", "altered source versions must be plainly marked as such", "zlib"),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense"),
    ("fuck", "do what the fuck you want to public license", "wtfpl"),
    ("beer", "you can buy me a beer in return", "beerware"),
    ("package", "the intent of this document is to state the conditions under which a package may be copied", "artistic"),
    ("reserved", "font software with reserved font name", "ofl"),
    ("font", "the font software may be sold as part of a larger software package", "ofl"),
    ("illinois", "university of illinois nor the names of its contributors may be used to endorse", "ncsa"),
    ("redistribute", "you are free to share copy and redistribute the material in any medium or format", "cc"),
    ("contributions", "you must distribute your contributions under the same license as the original", "cc-by-sa"),
    ("commercial", "you may not use the material for commercial purposes", "cc-by-nc"),
    ("modified", "you may not distribute the modified material", "cc-by-nd"),
    ("affirmer", "the affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "cc0"),
    ("waived", "has waived all copyright and related or neighboring rights", "cc0"),
    ("licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "busl"),
    ("hosted", "you may not provide the software to third parties as a hosted or managed service", "elastic"),
    ("service", "making the functionality of the program or modified version available to third parties as a service", "sspl"),
    ("psf", "psf hereby grants licensee a nonexclusive royalty free world wide license", "python"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code", "sleepycat"),
    ("database", "you are free to share create and adapt this database", "odbl"),
    ("modification", "permission to copy modify and distribute this work with or without modification for any purpose and without fee", "w3c"),
)
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.9, 4: 1.0}
TOP = max(CONFIDENCE)
#: Pieces of up to so many letters, where there are no longer ones, count for the gate only at the end of a word.
SHORT = 3
#: Between a word and its number; no word has it.
TAG = "\x01"


def rules() -> list[tuple[str, str, str, int, bool]]:
    """(keyword, expression, label, priority, whether its one group joins the label), highest priority first, then as listed.

    The order of the rules is theirs in this list: of detections of one place and priority the earlier rule's stays.
    """
    named = [
        (keyword, shape.format(name=f"(?:{name})"), label, priority, versioned)
        for priority, shape, versioned in SHAPES for keyword, name, label in NAMES
    ]
    own = [(keyword, expression, label, priority, re.compile(expression).groups == 1) for keyword, expression, label, priority in NOTICES]
    whole = [(keyword, expression, label, 3, False) for keyword, expression, label in SENTENCES]
    return sorted(own + whole + named, key=lambda r: -r[3])


def sure_pieces(expression: str) -> frozenset[str]:
    """Pieces of single words that every match of an expression has; a piece never holds a space."""
    gap = "\n"
    while (flat := re.sub(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[^}]*\})?", gap, expression)) != expression:
        expression = flat
    expression = re.sub(r"\[[^]]*\](?:[?*+]|\{[^}]*\})?|[a-z0-9][?*]", gap, expression)
    if "|" in expression:
        raise ValueError(f"alternatives outside a group: {expression!r}")
    return frozenset(re.findall(r"[^ \n]+", expression))


def is_short(clause: frozenset[str]) -> bool:
    return all(len(p) <= SHORT for p in clause)


def gate_clauses() -> list[frozenset[str]]:
    """Sets of pieces: a text that a rule or a phrase can find has all pieces of at least one set.

    Taken from the expressions of names, notices and phrases; a shape only puts words around a name.
    """
    expressions = [name for _, name, _ in NAMES] + [expression for _, expression, *_ in (*NOTICES, *SENTENCES)] + list(PHRASES)
    found = set()
    for expression in expressions:
        pieces = sure_pieces(expression)
        if not pieces:
            raise ValueError(f"no piece stands in every match of {expression!r}")
        # Most names have "licen", which is rare enough to stand alone.
        found.add(frozenset({"licen"}) if any("licen" in p for p in pieces) else pieces)
    within = lambda small, large: small < large if is_short(small) else all(any(p in q for q in large) for p in small)
    return sorted((c for c in found if not any(d != c and within(d, c) for d in found)), key=sorted)


def may_hold(lowered: Column) -> Column:
    """Whether a lower-cased text passes the gate. Pieces are looked for one at a time, so what parts words is free."""
    gate, short = F.lit(False), []
    for clause in gate_clauses():
        if is_short(clause):
            # As the end of a word: as a piece alone, "mpl" would stand in every "example".
            short.append(min(clause, key=lambda p: (-len(p), p)))
            continue
        whole = F.lit(True)
        for piece in sorted((p for p in clause if len(p) >= SHORT), key=lambda p: (-len(p), p)):
            whole = whole & F.contains(lowered, F.lit(piece))
        gate = gate | whole
    return gate | lowered.rlike(f"(?:{'|'.join(short)})(?:[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]|$)") if short else gate


def has_word(word: str) -> str:
    return f"(?<= ){word}(?= )"


def tagged(expression: str) -> str:
    """The expression over words that stand behind their number; a match begins with the number of its first word."""
    inner = re.sub(r" (\??)", lambda space: f"(?: [0-9]+{TAG})?" if space[1] else f" [0-9]+{TAG}", expression)
    return f"(?<= )[0-9]+{TAG}{inner}(?= )"


def places(numbered: Column, expression: Column) -> Column:
    """(start, end, match) of every match of a tagged expression over numbered words, in order.

    A match tells its place itself, so nothing is summed up along the text and time stays in proportion to it.
    """
    at = lambda m: F.substring_index(m, TAG, 1).cast("int")
    return F.transform(F.regexp_extract_all(numbered, expression, F.lit(0)), lambda m: F.struct(
        at(m).alias("start"), (at(m) + F.length(m) - F.length(F.replace(m, F.lit(TAG), F.lit("")))).alias("end"), F.regexp_replace(m, f"[0-9]+{TAG}", "").alias("match"),
    ))


def scanned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, ``base`` (start and label of every phrase place), ``detections`` (start, end, priority,
    label; in order) that were not suppressed.

    Every whole text is scanned, in time in proportion to it; a null text is empty. Of detections of one place and priority
    the earlier rule's stays. An action: what is found is written once. Repeated rows are repeated; an empty table gives no rows; other columns are not read.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lowered = body.withColumn("lowered", F.lower("body"))
    counted = lowered.select("doc_id", "body", F.size(F.filter(F.split("body", PARTING), lambda w: w != "")).cast("long").alias("n_words"), may_hold(F.col("lowered")).alias("gate"))
    words = F.filter(F.split(F.translate("body", UPPER, LOWER), PARTING), lambda w: w != "")
    passed = counted.select("doc_id", "n_words", F.when(F.col("gate"), words).alias("words"))
    spaced = F.concat(F.lit(" "), F.array_join(F.transform("words", lambda w, i: F.concat(i.cast("string"), F.lit(TAG), w)), " "), F.lit(" "))
    norms = passed.select("doc_id", "n_words", spaced.alias("norm"))
    known = F.array(*[
        F.struct(
            F.lit(n).alias("number"), F.lit(keyword).alias("keyword"), F.lit(tagged(expression)).alias("tagged"), F.lit(has_word(expression)).alias("expression"),
            F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(grouped).alias("grouped"),
        ) for n, (keyword, expression, label, priority, grouped) in enumerate(rules())
    ])
    active = norms.select("doc_id", "n_words", "norm", F.when(F.col("norm").isNotNull(), F.filter(known, lambda r: F.contains(F.col("norm"), F.concat(F.lit(TAG), r["keyword"], F.lit(" "))))).alias("rules"))
    phrases = F.array(*[F.struct(F.lit(tagged(p)).alias("tagged"), F.lit(label).alias("label")) for p, label in PHRASES.items()])
    label = lambda r, p: F.when(
        r["grouped"], F.concat_ws("-", r["label"], F.nullif(F.replace(F.call_function("regexp_extract", F.concat(F.lit(" "), p["match"], F.lit(" ")), r["expression"], F.lit(1)), F.lit(" "), F.lit("-")), F.lit(""))),
    ).otherwise(r["label"])
    found = active.select(
        "doc_id", "n_words", F.monotonically_increasing_id().alias("row"),
        F.when(F.col("norm").isNotNull(), F.flatten(F.transform(phrases, lambda r: F.transform(
            places(F.col("norm"), r["tagged"]), lambda p: F.struct(p["start"].alias("start"), r["label"].alias("label")),
        )))).alias("base"),
        F.when(F.size("rules") > 0, F.flatten(F.transform("rules", lambda r: F.transform(places(F.col("norm"), r["tagged"]), lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["number"].alias("number"), label(r, p).alias("label"),
        ))))).alias("all"),
    )
    # Written once with a number for each row, as rows with several detections meet themselves again below.
    found = write_through(found, "found")
    # By start, longer first, higher priority first, earlier rule first: what holds a detection stands before it. It is
    # suppressed if those before it, of its priority or a higher one, reach its end.
    order = ["start", "minus_end", "minus_priority", "number", "label"]
    each = found.where(F.size("all") > 1).select("row", F.explode("all").alias("d")).select("row", "d.*")
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("int")
    for p in range(1, TOP + 1):
        reach = F.when(F.col("minus_priority") == -p, F.max(F.when(F.col("minus_priority") <= -p, -F.col("minus_end"))).over(before)).otherwise(reach)
    kept = each.withColumn("reach", reach).where("reach is null or reach < -minus_end").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("kept"))
    shown = F.transform(F.coalesce("kept", F.when(F.size("all") == 1, F.col("all"))), lambda d: F.struct(
        d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"].alias("label"),
    ))
    return found.join(kept, "row", "left").select(
        "doc_id", "n_words", F.coalesce("base", F.array().cast("array<struct<start:int,label:string>>")).alias("base"),
        F.coalesce(shown, F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")).alias("detections"),
    )
