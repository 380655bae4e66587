"""Operator 4: licence recognition from known sentences, with DataFrame functions only.

A text is cut into sentences and each is normalised: lower case, words alone, and one form for each of the slots in which
references differ (who is licensed, the verb, versions, abbreviations). The normal form is looked up in a map of known
sentences; failing that, its first words in maps of sentences that go on in several ways; failing that, it is held against
the few forms with an open middle. The sequence of identifiers is matched against ordered rules: the first rule found in it
names a licence and uses its sentences up, then the next rule is tried on what is left. Everything happens within a row, so
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns

#: Known licence sentences in their normal form (fixed values); a star stands for any words, or none.
SENTENCES = (
    ("ApacheRef", "licensed under the apache license v2"),
    ("ApacheNoUse", "you may not use this file except in compliance with the license"),
    ("ApacheNoUse", "you may not use this work except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at *"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing *"),
    ("MITRef", "licensed under the mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software *"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies *"),
    ("AsIs", "the software is provided as is *"),
    ("AsIs", "this software is provided as is *"),
    ("AsIs", "this software is provided by the copyright holders and contributors as is *"),
    ("AsIs", "this software is provided by the regents and contributors as is *"),
    ("NoLiability", "in no event shall the authors *"),
    ("NoLiability", "in no event shall the copyright holder *"),
    ("NoLiability", "in no event shall the copyright holders *"),
    ("NoLiability", "in no event shall the copyright owner *"),
    ("NoLiability", "in no event shall the regents *"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *"),
    ("ISCGrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted *"),
    ("BSDGrant", "redistribution and use in source and binary forms with or without modification are permitted *"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice *"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice *"),
    ("BSDEndorse", "neither the name * may be used to endorse or promote products *"),
    ("BSD3Ref", "licensed under the 3 clause bsd license"),
    ("BSD2Ref", "licensed under the 2 clause bsd license"),
    ("BSDRef", "licensed under the bsd license"),
    ("GPL3Ref", "licensed under the gnu general public license v3"),
    ("GPL3LaterRef", "licensed under the gnu general public license v3 or later"),
    ("GPL2Ref", "licensed under the gnu general public license v2"),
    ("GPL2LaterRef", "licensed under the gnu general public license v2 or later"),
    ("GPLRedistribute", "you can redistribute it and or modify it under the gnu general public license *"),
    ("GPL3OrLater", "* either v3 of the license or * any later version"),
    ("GPL2OrLater", "* either v2 of the license or * any later version"),
    ("LGPL21Ref", "licensed under the gnu lesser general public license v2 1"),
    ("LGPL21LaterRef", "licensed under the gnu lesser general public license v2 1 or later"),
    ("LGPL3Ref", "licensed under the gnu lesser general public license v3"),
    ("LGPL3LaterRef", "licensed under the gnu lesser general public license v3 or later"),
    ("AGPL3Ref", "licensed under the gnu affero general public license v3"),
    ("AGPL3LaterRef", "licensed under the gnu affero general public license v3 or later"),
    ("MPLRef", "licensed under the mozilla public license v2"),
    ("CCBYNC", "licensed under cc by nc"),
    ("CCBYNC", "licensed under cc by nc 4"),
    ("CCBYSA", "licensed under cc by sa"),
    ("CCBYSA", "licensed under cc by sa 4"),
    ("CCBY", "licensed under cc by"),
    ("CCBY", "licensed under cc by 4"),
    ("CC0", "licensed under cc0"),
    ("CC0", "licensed under cc0 1"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("UnknownRef", "* licensed under * license *"),
)

_GRANT, _FSF = "you can redistribute it and or modify it under the gnu", "as published by the free software foundation either"
_LATER = "of the license or at your option any later version"
#: Sentences of the official notices, in the same form (fixed values).
NOTICES = (
    ("AGPL3Notice", f"{_GRANT} affero general public license {_FSF} v3 {_LATER}"),
    ("LGPL3Notice", f"{_GRANT} lesser general public license {_FSF} v3 {_LATER}"),
    ("LGPL21Notice", f"{_GRANT} lesser general public license {_FSF} v2 1 {_LATER}"),
    ("LGPL2Notice", f"{_GRANT} lesser general public license {_FSF} v2 {_LATER}"),
    ("GPL3Notice", f"{_GRANT} general public license {_FSF} v3 {_LATER}"),
    ("GPL2Notice", f"{_GRANT} general public license {_FSF} v2 {_LATER}"),
    ("AGPLRedistribute", f"{_GRANT} affero general public license *"),
    ("LGPLRedistribute", f"{_GRANT} lesser general public license *"),
    ("LGPL21OrLater", f"either v2 1 {_LATER}"),
)

#: Sentences by which whole licence texts are known (fixed values).
BODIES = (
    ("AGPL3Body", "the gnu affero general public license is a free copyleft license for software and other kinds of works *"),
    ("GPL3Body", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("GPL2Body", "this license applies to any program or other work which contains a notice placed by the copyright holder *"),
    ("LGPL3Body", "this version of the gnu lesser general public license incorporates the terms and conditions of v3 of the gnu general public license *"),
    ("LGPL21Body", "this license agreement applies to any software library or other program which contains a notice placed by the copyright holder *"),
    ("MPL2Body", "each contributor hereby grants you a world wide royalty free non exclusive license *"),
    ("ApacheBody", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("CCBYBody", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license *"),
    ("CCBYSABody", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license *"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license *"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications *"),
)

#: Ordered rules: licence and the identifiers that must follow one another (fixed values). Whole texts stand before references.
RULES = (
    ("MIT", ("MITGrant", "MITNotice", "AsIs", "NoLiability")),
    ("MIT", ("MITGrant", "MITNotice", "AsIs")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("ISC", ("ISCGrant", "AsIs", "NoLiability")),
    ("ISC", ("ISCGrant",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "AsIs", "NoLiability")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "AsIs", "NoLiability")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("Apache-2.0", ("ApacheRef", "ApacheNoUse", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheRef", "ApacheNoUse", "ApacheCopy")),
    ("GPL-3.0-or-later", ("GPLRedistribute", "GPL3OrLater")),
    ("GPL-2.0-or-later", ("GPLRedistribute", "GPL2OrLater")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITRef",)),
    ("BSD-3-Clause", ("BSD3Ref",)),
    ("BSD-2-Clause", ("BSD2Ref",)),
    ("BSD", ("BSDRef",)),
    ("GPL-3.0", ("GPL3Ref",)),
    ("GPL-3.0-or-later", ("GPL3LaterRef",)),
    ("GPL-2.0", ("GPL2Ref",)),
    ("GPL-2.0-or-later", ("GPL2LaterRef",)),
    ("LGPL-2.1", ("LGPL21Ref",)),
    ("LGPL-2.1-or-later", ("LGPL21LaterRef",)),
    ("LGPL-3.0", ("LGPL3Ref",)),
    ("LGPL-3.0-or-later", ("LGPL3LaterRef",)),
    ("AGPL-3.0", ("AGPL3Ref",)),
    ("AGPL-3.0-or-later", ("AGPL3LaterRef",)),
    ("MPL-2.0", ("MPLRef",)),
    ("CC-BY-NC-4.0", ("CCBYNC",)),
    ("CC-BY-SA-4.0", ("CCBYSA",)),
    ("CC-BY-4.0", ("CCBY",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense",)),
    ("AGPL-3.0", ("AGPL3Body",)),
    ("LGPL-3.0", ("LGPL3Body",)),
    ("LGPL-2.1", ("LGPL21Body",)),
    ("GPL-3.0", ("GPL3Body",)),
    ("GPL-2.0", ("GPL2Body",)),
    ("MPL-2.0", ("MPL2Body",)),
    ("Apache-2.0", ("ApacheBody",)),
    ("CC-BY-4.0", ("CCBYBody",)),
    ("CC-BY-SA-4.0", ("CCBYSABody",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Zlib", ("AsIs", "ZlibGrant")),
    ("unknown", ("UnknownRef",)),
)

#: Words of which every known sentence has one: a text or sentence without any is passed over.
LIKELY = r"(?i)licen[cs]e|released|distribut|permission|copyright|provided|in[^a-z0-9]+no[^a-z0-9]+event|neither|version|unless|public[^a-z0-9]+domain"
#: Ends of sentences: a stop, question or exclamation mark or semicolon before white space, a colon before a line end, an empty line.
CUT = r"[.!?;]+(?:\s+|$)|\n\s*\n|:\s*\n"
#: Rules of the notices: those tried before the others, and those of a redistribution grant alone, tried after them.
NOTICE_RULES = (
    ("AGPL-3.0-or-later", ("AGPL3Notice",)),
    ("LGPL-3.0-or-later", ("LGPL3Notice",)),
    ("LGPL-2.1-or-later", ("LGPL21Notice",)),
    ("LGPL-2.0-or-later", ("LGPL2Notice",)),
    ("GPL-3.0-or-later", ("GPL3Notice",)),
    ("GPL-2.0-or-later", ("GPL2Notice",)),
    ("AGPL-3.0-or-later", ("AGPLRedistribute", "GPL3OrLater")),
    ("LGPL-3.0-or-later", ("LGPLRedistribute", "GPL3OrLater")),
    ("LGPL-2.1-or-later", ("LGPLRedistribute", "LGPL21OrLater")),
    ("LGPL-2.0-or-later", ("LGPLRedistribute", "GPL2OrLater")),
)
LONE_RULES = (("AGPL", ("AGPLRedistribute",)), ("LGPL", ("LGPLRedistribute",)), ("GPL", ("GPLRedistribute",)))

#: CUT, but not after the stop of "v. 2".
STOP = r"(?!(?<=\b[vV])\.\s+[0-9])" + f"(?:{CUT})"
#: Comment marks at the start of a line.
MARKS = r"(?m)^[ \t]*(?://+|#+|\*+|--|;+|/\*+)[ \t]?"

#: What makes the slots of a sentence one form, in order: a number in front of a condition, who is licensed, the verb, terms,
#: abbreviations, versions and their final zero, names of clauses.
SLOTS = (
    (r"^[0-9a-z] (?=redistributions |neither )", ""),
    (r"^.* is free software (?=you can redistribute )", ""),
    (r"^(?:this|the) (?:file|work|software|project|code|program|library|package|source code form) is (?=licensed |released |distributed |subject )", ""),
    (r"\b(?:released|distributed) (?=under )|\bsubject to (?=the terms )", "licensed under "),
    (r"\blicensed (?:under )+", "licensed under "),
    (r"\bunder (?:the )?terms of the ", "under the "),
    (r"\bgnu library general public license", "gnu lesser general public license"),
    (r"\bgnu gpl\b", "gnu general public license"),
    (r"\bgnu lgpl\b", "gnu lesser general public license"),
    (r"\bgnu agpl\b", "gnu affero general public license"),
    (r"\b(?:version |v )(?=[0-9])", "v"),
    (r"\b(v[0-9]) 0\b", "$1"),
    (r"^(licensed under cc(?: by(?: nc| sa)?|0) [0-9]) 0$", "$1"),
    (r"\b(?:three|3) clause bsd license|\bbsd 3 clause(?: license)?", "3 clause bsd license"),
    (r"\b(?:two|2) clause bsd license|\bbsd 2 clause(?: license)?", "2 clause bsd license"),
    (r"^(licensed under the apache license v2) the license$", "$1"),
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal(sentence: Column) -> Column:
    """Lower-cased, in American spelling, words alone with single blanks, slots in one form."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "licence", "license"), r"[^a-z0-9]+", " "))
    for pattern, form in SLOTS:
        out = F.regexp_replace(out, pattern, form)
    return out


def _kinds() -> tuple[dict[str, str], dict[int, dict[str, str]], list[tuple[str, str]]]:
    """Known sentences as {sentence: identifier}, {number of first words: {words: identifier}} and [(identifier, form)] of open middles."""
    whole, openings, open_ = {}, {}, []
    for name, form in NOTICES + BODIES + SENTENCES:
        if "*" not in form:
            whole[form] = name
        elif form.index("*") == len(form) - 1:
            words = form[:-2]
            openings.setdefault(words.count(" ") + 1, {})[words] = name
        else:
            open_.append((name, form))
    return whole, openings, open_


def _pattern(form: str) -> str:
    """A form with stars as a regular expression."""
    out = f" {form} ".replace(" * ", "\0").strip(" ")
    parts = [p.strip(" ") for p in out.split("\0")]
    return "^" + (r"(?:.* )?" if not parts[0] else "") + " (?:.* )?".join(p for p in parts if p) + (r"(?: .*)?$" if not parts[-1] else "$")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def identifier(sentence: Column) -> Column:
    """The known sentence a normalised one is, any but a reference to an unknown licence; null for any other."""
    whole, openings, open_ = _kinds()
    tries = [F.try_element_at(_map(whole), sentence)]
    tries += [F.try_element_at(_map(openings[k]), F.substring_index(sentence, " ", k)) for k in sorted(openings, reverse=True)]
    tries += [F.when(sentence.rlike(_pattern(form)), name) for name, form in open_ if name != "UnknownRef"]
    return F.coalesce(*tries)


def refers(sentence: Column) -> Column:
    """Whether a normalised sentence refers to some licence."""
    return sentence.rlike(_pattern(SENTENCES[-1][1]))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. A sentence that isn't known is tried again line by line."""
    likely = F.filter(F.split(F.regexp_replace(text, MARKS, ""), STOP), lambda s: s.rlike(LIKELY))
    line = lambda y: _once(normal(y), lambda n: F.coalesce(identifier(n), F.when(refers(n), "UnknownRef")))
    unknown = F.array(F.lit("UnknownRef"))

    def each(s: Column) -> Column:
        # a reference to an unknown licence may run over lines, but not where one of them is known by itself
        lines = F.filter(F.transform(F.split(s, r"\n"), line), lambda x: x.isNotNull())
        wrapped = lambda n: _once(lines, lambda own: F.when((F.size(own) == 0) & refers(n), unknown).otherwise(own))
        return _once(normal(s), lambda n: _once(F.array(identifier(n)), lambda own: F.when(F.get(own, F.lit(0)).isNotNull(), own).otherwise(wrapped(n))))

    return F.flatten(F.transform(likely, each))


def match_rules(found: Column) -> Column:
    """Licences by the ordered rules over a sequence of identifiers: sorted, each once."""
    text = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    hits = []
    for licence, sequence in NOTICE_RULES + RULES + LONE_RULES:
        needle = f" {'  '.join(sequence)} "
        hits.append(F.when(F.instr(text, needle) > 0, F.lit(licence)))
        text = F.replace(text, F.lit(needle), F.lit(" | "))
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences) per row of docs: identifiers in order and licences sorted, both joined by a blank.

    Null and empty texts and those without a known sentence have empty strings; null ids and repeated rows are scanned like
    any other; an empty table gives no rows; other columns are ignored. A text of any length is scanned whole, in one row.
    """
    source = own_columns(docs, doc_id=id_col, text=text_col)
    none = F.array().cast("array<string>")
    found = source.select("doc_id", F.when(F.col("text").rlike(LIKELY), identifiers(F.col("text"))).otherwise(none).alias("ids"))
    named = found.select("doc_id", "ids", F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(none).alias("names"))
    return named.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.array_join("names", " ").alias("licences"))


def oracle_sql() -> str:
    """scan() of documents in SQL: no text or sentence is passed over. It has the sentences and rules as data, and a way of its
    own to cut, to normalise and to compare: slots without looking ahead, openings by prefix, open middles by LIKE."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rules = NOTICE_RULES + RULES + LONE_RULES
    known = NOTICES + BODIES + SENTENCES
    rows = ", ".join(f"({k}, {q(name)}, {q(form)})" for k, (name, form) in enumerate(known))
    steps = [
        (r"^[0-9a-z] (redistributions|neither) ", r"\1 "), (r"^.* is free software you can redistribute ", "you can redistribute "),
        (r"^(this|the) (file|work|software|project|code|program|library|package|source code form) is (licensed|released|distributed|subject) ", r"\3 "),
        (r"\b(released|distributed) under ", "licensed under "), (r"\bsubject to the terms ", "licensed under the terms "), (r"\blicensed (under )+", "licensed under "),
        (r"\bunder (the )?terms of the ", "under the "), (r"\bgnu (library general public license|lgpl\b)", "gnu lesser general public license"), (r"\bgnu gpl\b", "gnu general public license"),
        (r"\bgnu agpl\b", "gnu affero general public license"), (r"\b(version|v) ([0-9])", r"v\2"), (r"\b(v[0-9]) 0\b", r"\1"), (r"^(licensed under cc( by| by nc| by sa|0) [0-9]) 0$", r"\1"),
        (r"\b((three|3) clause bsd license|bsd 3 clause( license)?)", "3 clause bsd license"), (r"\b((two|2) clause bsd license|bsd 2 clause( license)?)", "2 clause bsd license"), (r"^licensed under the apache license v2 the license$", "licensed under the apache license v2"),
    ]

    def norm(x: str) -> str:
        out = f"trim(regexp_replace(replace(lower({x}), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, form in steps:
            out = f"regexp_replace({out}, {q(pattern)}, {q(form)}, 'g')"
        return out

    needles = [f" {'  '.join(sequence)} " for _, sequence in rules]
    walked = ", ".join(f"replace(r{k}, '{n}', ' | ') AS r{k + 1}" for k, n in enumerate(needles))
    hits = ", ".join(f"CASE WHEN contains(r{k}, '{n}') THEN '{rules[k][0]}' END" for k, n in enumerate(needles))
    body = r"regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^[ \t]*(//+|#+|\*+|--|;+|/\*+)[ \t]?', '', 'g'), '\b([vV])\.(\s+[0-9])', '\1\2', 'g')"
    cut = rf"regexp_split_to_array({body}, '[.!?;]+(?:\s+|$)|\n\s*\n|:\s*\n')"
    return f"""
WITH forms(nth, name, form) AS (VALUES {rows}),
wholes AS (SELECT name, form FROM forms WHERE NOT contains(form, '*')), openings AS (SELECT name, form[:-3] AS opening, length(form) AS size FROM forms WHERE ends_with(form, ' *') AND len(string_split(form, '*')) = 2),
middles AS (SELECT nth, name, replace(replace(' ' || form || ' ', ' * ', '% '), '% %', '%') AS pattern FROM forms WHERE contains(form[:-3], '*') AND name <> 'UnknownRef'),
raw AS (SELECT doc_id, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS place FROM documents),
lines AS (SELECT doc_id, place, unnest(list_concat([s], string_split(s, chr(10)))) AS s, generate_subscripts(list_concat([s], string_split(s, chr(10))), 1) AS nth FROM raw),
normal AS (SELECT doc_id, place, nth, {norm("s")} AS n FROM lines),
texts AS (SELECT DISTINCT n FROM normal WHERE n <> ''),
by_opening AS (SELECT n, arg_max(name, size) AS name FROM texts JOIN openings ON starts_with(n || ' ', opening || ' ') GROUP BY n),
by_middle AS (SELECT n, arg_min(name, nth) AS name FROM texts JOIN middles ON ' ' || n || ' ' LIKE pattern GROUP BY n),
told AS (SELECT t.n, coalesce(w.name, o.name, m.name) AS name, ' ' || t.n || ' ' LIKE '% licensed under % license %' OR ' ' || t.n || ' ' LIKE '% licensed under license %' AS refers
  FROM texts t LEFT JOIN wholes w ON w.form = t.n LEFT JOIN by_opening o ON o.n = t.n LEFT JOIN by_middle m ON m.n = t.n),
named AS (SELECT doc_id, place, nth, name, coalesce(refers, false) AS refers FROM normal LEFT JOIN told USING (n)),
whole AS (SELECT doc_id, place, name, refers FROM named WHERE nth = 1),
single AS (SELECT doc_id, place, nth, coalesce(name, CASE WHEN refers THEN 'UnknownRef' END) AS name FROM named WHERE nth > 1),
own AS (SELECT doc_id, place, string_agg(name, ' ' ORDER BY nth) AS names FROM single GROUP BY ALL),
each AS (SELECT w.doc_id, w.place, coalesce(w.name, o.names, CASE WHEN w.refers THEN 'UnknownRef' END) AS names FROM whole w JOIN own o USING (doc_id, place)),
ids AS (SELECT doc_id, coalesce(string_agg(names, ' ' ORDER BY place), '') AS sentence_ids FROM each GROUP BY doc_id),
walked AS (SELECT doc_id, sentence_ids, ' ' || replace(sentence_ids, ' ', '  ') || ' ' AS r0, {walked} FROM ids)
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ' ') AS licences FROM walked
"""
