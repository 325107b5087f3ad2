"""License scan: ordered signature rules behind a keyword prefilter, with containment suppression.

Only DataFrame and SQL functions are used, all within a row, so nothing is shuffled. A text becomes its words, lower-cased (A-Z only)
and space-joined with a space on either side; every rule is a regex over that. Texts without any keyword run no rule.
A null text counts as empty. Extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, running

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Signature rules by group: notices are written out one by one, names with versions are made from the tables below. A group has a priority (texts of notices before named versions before bare names) and
# its rules have a keyword that every match holds as a word (with * as the start of one), the label, and the regex over normalised
# words.
_VERSION = r"(?:v|ver|version|versions)?"
NOTICES = (
    ("warranty", "mit", r"the software is provided as is without warranty of any kind"),
    ("permission", "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission", "mit", r"the above copyright notice and this permission notice shall be included"),
    ("permission", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("permission", "isc", r"permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("redistributions", "bsd", r"redistributions of source code must retain the above copyright notice"),
    ("redistributions", "bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("endorse", "bsd-3-clause", r"to endorse or promote products derived from this software without specific prior written permission"),
    ("advertising", "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("licensed", "apache-2.0", r"licensed under the apache license version 2 0 the license"),
    ("compliance", "apache-2.0", r"you may not use this file except in compliance with the license"),
    ("distributed", "apache-2.0", r"software distributed under the license is distributed on an as is basis"),
    ("gnu", "gpl", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gnu", "lgpl", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("gnu", "agpl", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gnu", "gfdl", r"under the terms of the gnu free documentation license version 1 [0-3]"),
    ("merchantability", "gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mozilla", "mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mozilla", "mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("eclipse", "epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain"),
    ("fuck", "wtfpl", r"do what the fuck you want to public license"),
    ("misrepresented", "zlib", r"the origin of this software must not be misrepresented"),
    ("boost", "bsl-1.0", r"distributed under the boost software license version 1 0"),
    ("artistic", "artistic-2.0", r"under the terms of the artistic license 2 0"),
    ("dedicated", "cc0-1.0", r"dedicated all copyright and related and neighboring rights to this software to the public domain"),
    ("reserved", "proprietary", r"all rights reserved"),
    ("confidential", "proprietary", r"confidential and proprietary"),
    ("reproduced", "proprietary", r"no part of this (?:publication|work|book|document) may be reproduced"),
)
_CC_PARTS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s(?: works)?"),
             ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
             ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_GNU = (("gpl", "general public license", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general public license", ("2", "2.1", "3")),
        ("agpl", "affero general public license", ("1", "3")), ("gfdl", "free documentation license", ("1.1", "1.2", "1.3")))
_NAMED = (
    # label, name in words, versions, keyword
    ("apache", "apache(?: software)? license", ("1.0", "1.1", "2.0"), "apache"),
    ("mpl", "mozilla public license", ("1.0", "1.1", "2.0"), "mozilla"),
    ("epl", "eclipse public license", ("1.0", "2.0"), "eclipse"),
    ("cpl", "common public license", ("1.0",), "public"),
    ("cddl", "common development and distribution license", ("1.0", "1.1"), "distribution"),
    ("eupl", "european union public licen[sc]e", ("1.0", "1.1", "1.2"), "european"),
    ("osl", "open software license", ("1.0", "2.0", "2.1", "3.0"), "open"),
    ("afl", "academic free license", ("1.1", "2.0", "2.1", "3.0"), "academic"),
    ("artistic", "artistic license", ("1.0", "2.0"), "artistic"),
    ("bsl", "boost software license", ("1.0",), "boost"),
    ("psf", "python software foundation license", ("2",), "python"),
    ("ofl", "sil open font license", ("1.0", "1.1"), "sil"),
    ("odbl", "open (?:data commons open )?database license", ("1.0",), "database"),
    ("ms-pl", "microsoft public license", (), "microsoft"),
    ("ms-rl", "microsoft reciprocal license", (), "microsoft"),
    ("zpl", "zope public license", ("1.1", "2.0", "2.1"), "zope"),
    ("lppl", "latex project public license", ("1.0", "1.2", "1.3"), "latex"),
    ("qpl", "q public license", ("1.0",), "public"),
    ("cecill", "cecill license", ("1.0", "1.1", "2.0", "2.1"), "cecill"),
    ("upl", "universal permissive license", ("1.0",), "universal"),
    ("ncsa", "university of illinois(?: ncsa)? open source license", (), "illinois"),
    ("php", "php license", ("3.0", "3.01"), "php"),
    ("openssl", "openssl license", (), "openssl"),
    ("ruby", "ruby license", (), "ruby"),
    ("vim", "vim license", (), "vim"),
    ("w3c", "w3c software(?: notice and)? license", (), "w3c"),
    ("x11", "x11 license", (), "x11"),
    ("bsd", "(?:new |modified |simplified )?bsd license", (), "bsd"),
    ("mit", "(?:the )?mit license", (), "mit"),
    ("isc", "isc license", (), "isc"),
    ("zlib", "zlib(?: libpng)? license", (), "zlib"),
    ("sspl", "server side public license", ("1",), "server"),
    ("busl", "business source license", ("1.0", "1.1"), "business"),
    ("elastic", "elastic license", ("1.0", "2.0"), "elastic"),
    ("mulan", "mulan permissive software license", ("1", "2"), "mulan"),
    ("etalab", "licence ouverte", ("1.0", "2.0"), "ouverte"),
    ("ogl", "open government licence", ("1.0", "2.0", "3.0"), "government"),
    ("cdla", "community data license agreement", (), "community"),
    ("llama", "llama [0-9 ]*community license", (), "llama"),
    ("rail", "open ?rail(?: [ms])?", (), "open*"),
)


def _words(version: str) -> str:
    return version.removesuffix(".0").replace(".", " ") + ("(?: 0)?" if version.endswith(".0") or "." not in version else "")


def _gate(keyword: str) -> str:
    """What a normalised text holds where the keyword stands."""
    return f" {keyword[:-1]}" if keyword.endswith("*") else f" {keyword} "


def rules() -> list[dict]:
    """The signature rules in order: gate (a text without it has no match), label, regex, priority (higher wins) and confidence."""
    out = [{"gate": _gate(k), "label": n, "regex": r, "priority": 3, "confidence": 0.95} for k, n, r in NOTICES]
    put = lambda keyword, label, regex, priority, confidence: out.append(
        {"gate": _gate(keyword), "label": label, "regex": regex, "priority": priority, "confidence": confidence}
    )
    for part, name in _CC_PARTS:
        for v in _CC_VERSIONS:
            put("cc", f"cc-{part}-{v}", rf"cc {part.replace('-', ' ')} {_words(v)}", 2, 0.95)
            put("creative", f"cc-{part}-{v}", rf"creative commons {name} {_words(v)}(?: international| unported| generic)?", 2, 0.95)
            put("creativecommons", f"cc-{part}-{v}", rf"creativecommons org licenses {part.replace('-', ' ')} {_words(v)}", 2, 1.0)
        put("cc", f"cc-{part}", rf"cc {part.replace('-', ' ')}", 1, 0.7)
        put("creative", f"cc-{part}", rf"creative commons {name}", 1, 0.75)
    put("cc0", "cc0-1.0", r"cc0(?: 1(?: 0)?)?", 2, 0.9)
    put("creative", "cc", r"creative commons licen[sc]e", 1, 0.6)
    for label, name, versions in _GNU:
        for v in versions:
            put("license", f"{label}-{v}", rf"(?:gnu )?{name} {_VERSION} ?{_words(v)}(?: or (?:any )?later(?: version)?)?", 2, 0.95)
            put(f"{label}*", f"{label}-{v}", rf"{label} ?v? ?{_words(v)}(?: only| or later)?", 2, 0.85)
        put("gnu", label, rf"gnu {name}", 1, 0.8)
        put(label, label, rf"(?:gnu )?{label}", 0, 0.5)
    for label, name, versions, keyword in _NAMED:
        for v in versions:
            put(keyword, f"{label}-{v}", rf"{name} {_VERSION} ?{_words(v)}", 2, 0.95)
            put(label, f"{label}-{v}", rf"{label} {_VERSION} ?{_words(v)}", 2, 0.8)
        put(keyword, label, name, 1, 0.8)
    for n in ("2", "3", "4"):
        put("bsd", f"bsd-{n}-clause", rf"bsd {n} clause(?: license)?", 2, 0.95)
        put("bsd", f"bsd-{n}-clause", rf"{n} clause bsd(?: license)?", 2, 0.95)
    put("spdx", "spdx", r"spdx license identifier [a-z0-9]+(?: [a-z0-9]+)?", 1, 0.7)
    put("public", "public-domain", r"(?:in|into|to) the public domain", 1, 0.7)
    put("copyright", "copyright", r"copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?", 0, 0.3)
    put("licensed", "licensed", r"licensed under", 0, 0.2)
    put("license", "license", r"license", 0, 0.1)
    put("licence", "license", r"licence", 0, 0.1)
    return out


def normalised(text: Column) -> Column:
    """The words of ``text``, each with a space before it, and one space at the end; without words, one space."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), BETWEEN, " ")


def _any_of(texts: list[str]) -> str:
    """A regex for any of ``texts`` in which common beginnings stand once, so that most places fail at a letter or two."""
    if "" in texts:
        return ""
    by_first: dict[str, list[str]] = {}
    for t in sorted(texts):
        by_first.setdefault(t[0], []).append(t[1:])
    parts = [c + _any_of(rest) for c, rest in by_first.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _spaces(part: Column) -> Column:
    return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")


def _matched(norm: str, tests: list[dict], gated: bool = True) -> str:
    """SQL for the matches of each rule of ``tests`` in ``norm``: array<struct<rule, found, gaps>>.

    Every pattern is a literal, so it is compiled once a task, and a rule runs only where its gate's text stands. As SQL the hundreds
    of rules are parsed in the JVM in one go.
    """
    none = "slice(array(named_struct('rule', 0, 'found', array(''), 'gaps', array(''))), 1, 0)"
    by_gate: dict[str, list[str]] = {}
    for i, r in enumerate(tests):
        regex = f"r' (?:{r['regex']})(?= )'"
        hit = f"named_struct('rule', {i}, 'found', regexp_extract_all({norm}, {regex}, 0), 'gaps', split({norm}, {regex}, -1))"
        by_gate.setdefault(r["gate"] if gated else " ", []).append(f"if({norm} rlike {regex}, {hit}, null)")
    groups = [
        f"if(contains({norm}, '{gate}'), filter(array({', '.join(hits)}), x -> x is not null), {none})"
        for gate, hits in by_gate.items()
    ]
    # most texts hold no gate at all, and one pass tells
    return f"if({norm} rlike r'{_any_of(list(by_gate))}', flatten(array({', '.join(groups)})), {none})"


def _places(hit: Column) -> Column:
    """Starts and stops, in words, of a rule's matches: from the text between them and their own lengths."""
    steps = F.zip_with(
        F.slice(hit["gaps"], F.lit(1), F.size(hit["found"])),
        hit["found"],
        lambda g, m: F.struct(_spaces(g).alias("gap"), _spaces(m).alias("long")),
    )
    return running(
        steps,
        F.lit(0).cast("long"),
        lambda at, x: (
            at + x["gap"] + x["long"],
            F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("stop")),
        ),
        "struct<start:bigint,stop:bigint>",
    )


def _unsuppressed(hits: Column, levels: list[int]) -> Column:
    """The hits that no other one suppresses. Sorted by start, and the longer first, a container stands before what it contains: it
    is enough to carry the furthest stop so far of each priority."""

    def step(s: Column, x: Column):
        stop, priority = -x["minus_stop"], -x["minus_priority"]
        contained = F.lit(False)
        for p in levels:
            contained = contained | ((F.lit(p) >= priority) & (s[f"to{p}"] >= stop))
        state = F.struct(
            *[F.when(priority == p, F.greatest(s[f"to{p}"], stop)).otherwise(s[f"to{p}"]).alias(f"to{p}") for p in levels]
        )
        given = F.struct(
            x["start"].alias("start"), stop.alias("stop"), x["label"].alias("label"), priority.alias("priority"),
            x["confidence"].alias("confidence"), contained.alias("contained"),
        )
        return state, given

    first = F.struct(*[F.lit(-1).cast("long").alias(f"to{p}") for p in levels])
    kind = "struct<start:bigint,stop:bigint,label:string,priority:int,confidence:double,contained:boolean>"
    kept = F.filter(running(F.array_sort(hits), first, step, kind), lambda x: ~x["contained"])
    names = ("start", "stop", "label", "priority", "confidence")
    return F.transform(kept, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def scan(docs: DataFrame, text: str = "text", gated: bool = True) -> DataFrame:
    """Add ``license``: struct<n_words, base array<struct<start, label>>, found array<struct<start, stop, label, priority,
    confidence>>>. Words count from 0, stops are exclusive.

    ``base`` has every place of a base phrase. ``found`` has the matches of the signature rules that are left after suppression:
    a match goes if another one of higher priority contains it, or one of the same priority that is longer, or equal and of
    an earlier rule. A column of that name is replaced; no other name is used. ``gated`` is for tests: without it every rule runs on every text.
    """
    own = rules()
    phrases = [{"gate": f" {p} ", "label": n, "regex": p, "priority": 0, "confidence": 0.0} for p, n in BASE]
    tests = own + phrases
    labels = F.array(*[F.lit(r["label"]) for r in tests])
    priorities = F.array(*[F.lit(r["priority"]) for r in tests])
    confidences = F.array(*[F.lit(r["confidence"]) for r in tests])

    def signature(hit: Column) -> Column:
        return F.transform(
            _places(hit),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["stop"]).alias("minus_stop"),
                (-F.get(priorities, hit["rule"])).alias("minus_priority"),
                hit["rule"].alias("rule"),
                F.get(labels, hit["rule"]).alias("label"),
                F.get(confidences, hit["rule"]).alias("confidence"),
            ),
        )

    def phrase(hit: Column) -> Column:
        return F.transform(_places(hit), lambda s: F.struct(s["start"].alias("start"), F.get(labels, hit["rule"]).alias("label")))

    def told(x: Column) -> Column:
        hits, n = x["hits"], len(own)
        base = F.flatten(F.transform(F.filter(hits, lambda h: h["rule"] >= n), phrase))
        found = F.flatten(F.transform(F.filter(hits, lambda h: h["rule"] < n), signature))
        found = _unsuppressed(found, sorted({r["priority"] for r in own}))
        return F.struct((_spaces(x["norm"]) - 1).alias("n_words"), base.alias("base"), found.alias("found"))

    # the text is normalised once, then matched once
    name = f"license_{uuid.uuid4().hex}"
    matched = docs.withColumn(name, normalised(F.col(f"`{text}`"))).withColumn(
        name, F.expr(f"transform(array(`{name}`), n -> named_struct('norm', n, 'hits', {_matched('n', tests, gated)}))[0]")
    )
    return matched.withColumn("license", bound(F.col(name), told)).drop(name)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of every whole text of ``documents``. One row a row of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base, found = F.col("license.base"), F.col("license.found")
    names = lambda a: F.transform(a, lambda x: x["label"])
    starts = F.transform(base, lambda x: x["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    # one minus the product of doubts over distinct labels and strengths
    doubt = F.aggregate(
        F.array_distinct(F.transform(found, lambda x: F.struct(x["label"].alias("l"), x["confidence"].alias("c")))),
        F.lit(1.0),
        lambda s, x: s * (F.lit(1.0) - x["c"]),
    )
    return scan(docs).select(
        "doc_id",
        F.col("license.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names(base)).alias("base_labels"),
        joined(F.concat(names(base), names(found))).alias("labels"),
        F.when(F.size(base) > 0, F.greatest(F.lit(0.8), F.lit(1.0) - doubt)).otherwise(F.lit(1.0) - doubt).alias("score"),
    )
