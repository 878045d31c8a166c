"""License scan: ordered signature rules behind a keyword gate, in DataFrame functions only.

A text is brought to one form: words ``[0-9A-Za-z]`` and all characters over 0x7F, each between single
spaces. Matching ignores the case of A-Z alone. Three phrases are the base; the rest are signature
rules, each a regex with a label, a priority tier and a keyword. A text without any keyword costs one
regex; with one, only rules whose keyword it holds are tried. Every match is an interval of the
normal form. An interval that lies within another of the same or a higher tier is suppressed (equal
intervals: the higher tier, then the earlier rule stays). One sorted sweep per text keeps the furthest
end of each tier, so the cost is linear in the matches.

The score is the confidence of the surest finding that stays: full texts and SPDX tags over names
over hints; 0 where there is none.

Defined results: null and empty texts have no words and no labels, and null first_word and last_word;
repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed by the query's contract: phrases of consecutive words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

NOTICE, TAG, NAME, HINT = 4, 3, 2, 1
CONFIDENCE = {NOTICE: 1.0, TAG: 0.95, NAME: 0.8, HINT: 0.4}

_V = r"(?: v(?:ersion)?)? ?"

#: Short keywords that gate as the start of a word: digits or letters may follow at once ("gpl3").
STEMS = {"agpl", "beer", "gpl", "lgpl"}

#: Families: label, keyword (one word or the start of one), SPDX id as words, name as a regex.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("afl-3.0", "academic", "afl 3 0", rf"academic free license{_V}3(?: 0)?"),
    ("agpl-1.0", "affero", "agpl 1 0", rf"affero general public license{_V}1(?: 0)?"),
    ("agpl-3.0", "affero", "agpl 3 0", rf"(?:gnu )?affero general public license{_V}3(?: 0)?"),
    ("apache-1.1", "apache", "apache 1 1", rf"apache(?: software)? license{_V}1 1"),
    ("apache-2.0", "apache", "apache 2 0", rf"apache(?: software)? license{_V}2(?: 0)?"),
    ("apsl-2.0", "apple", "apsl 2 0", rf"apple public source license{_V}2(?: 0)?"),
    ("artistic-1.0", "artistic", "artistic 1 0", rf"artistic license{_V}1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic 2 0", rf"artistic license{_V}2(?: 0)?"),
    ("beerware", "beer", "beerware", r"beer ?ware license"),
    ("bsd-1-clause", "bsd", "bsd 1 clause", r"(?:1|one) clause bsd license"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", r"(?:(?:2|two) clause|simplified|freebsd) bsd license"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:(?:3|three) clause|new|revised|modified) bsd license"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"(?:(?:4|four) clause|original) bsd license"),
    ("bsl-1.0", "boost", "bsl 1 0", rf"boost software license(?:{_V}1(?: 0)?)?"),
    ("busl-1.1", "business", "busl 1 1", rf"business source license(?:{_V}1 1)?"),
    ("cc-by", "commons", "cc by [1-4] [05]", r"creative commons attribution(?: licen[sc]e)?(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc", "commons", "cc by nc(?: [1-4] [05])?", r"creative commons attribution non ?commercial"),
    ("cc-by-nc-nd", "commons", "cc by nc nd(?: [1-4] [05])?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "commons", "cc by nc sa(?: [1-4] [05])?", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nd", "commons", "cc by nd(?: [1-4] [05])?", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "commons", "cc by sa(?: [1-4] [05])?", r"creative commons attribution share ?alike"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?", r"cc0(?: 1 0)? universal"),
    ("cddl-1.0", "common", "cddl 1 0", rf"common development and distribution license(?:{_V}1(?: 0)?)?"),
    ("cddl-1.1", "common", "cddl 1 1", rf"common development and distribution license{_V}1 1"),
    ("cecill-2.1", "cecill", "cecill 2 1", rf"cecill(?: free software)? license(?: agreement)?(?:{_V}2 1)?"),
    ("cecill-b", "cecill", "cecill b", r"cecill b(?: free software)? license"),
    ("cecill-c", "cecill", "cecill c", r"cecill c(?: free software)? license"),
    ("cpl-1.0", "common", "cpl 1 0", rf"common public license(?:{_V}1(?: 0)?)?"),
    ("ecl-2.0", "educational", "ecl 2 0", rf"educational community license(?:{_V}2(?: 0)?)?"),
    ("efl-2.0", "eiffel", "efl 2 0", rf"eiffel forum license(?:{_V}2(?: 0)?)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", rf"elastic license(?:{_V}2(?: 0)?)?"),
    ("epl-1.0", "eclipse", "epl 1 0", rf"eclipse public license{_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", "epl 2 0", rf"eclipse public license{_V}2(?: 0)?"),
    ("eupl-1.1", "european", "eupl 1 1", rf"european union public licen[sc]e{_V}1 1"),
    ("eupl-1.2", "european", "eupl 1 2", rf"european union public licen[sc]e{_V}1 2"),
    ("fsfap", "fsf", "fsfap", r"fsf all permissive license"),
    ("gfdl-1.2", "documentation", "gfdl 1 2", rf"(?:gnu )?free documentation license{_V}1 2"),
    ("gfdl-1.3", "documentation", "gfdl 1 3", rf"(?:gnu )?free documentation license{_V}1 3"),
    ("gpl-1.0", "general", "gpl 1 0", rf"(?:gnu )?general public license{_V}1(?: 0)?"),
    ("gpl-2.0", "general", "gpl 2 0", rf"(?:gnu )?general public license{_V}2(?: 0)?"),
    ("gpl-3.0", "general", "gpl 3 0", rf"(?:gnu )?general public license{_V}3(?: 0)?"),
    ("hpnd", "historical", "hpnd", r"historical permission notice and disclaimer"),
    ("icu", "icu", "icu", r"icu license"),
    ("ijg", "jpeg", "ijg", r"independent jpeg group license"),
    ("ipl-1.0", "ibm", "ipl 1 0", rf"ibm public license(?:{_V}1(?: 0)?)?"),
    ("isc", "isc", "isc", r"isc license"),
    ("json", "json", "json", r"json license"),
    ("lgpl-2.0", "general", "lgpl 2 0", rf"(?:gnu )?library general public license(?:{_V}2(?: 0)?)?"),
    ("lgpl-2.1", "general", "lgpl 2 1", rf"(?:gnu )?lesser general public license{_V}2 1"),
    ("lgpl-3.0", "general", "lgpl 3 0", rf"(?:gnu )?lesser general public license{_V}3(?: 0)?"),
    ("libpng", "libpng", "libpng", r"(?:zlib )?libpng license"),
    ("lppl-1.3c", "latex", "lppl 1 3c", rf"latex project public license(?:{_V}1 3c?)?"),
    ("lpl-1.02", "lucent", "lpl 1 02", rf"lucent public license(?:{_V}1(?: 02)?)?"),
    ("mit", "mit", "mit", r"mit(?: x11| expat)? license"),
    ("mit-0", "mit", "mit 0", r"mit no attribution(?: license)?"),
    ("mpl-1.0", "mozilla", "mpl 1 0", rf"mozilla public license{_V}1(?: 0)?"),
    ("mpl-1.1", "mozilla", "mpl 1 1", rf"mozilla public license{_V}1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", rf"mozilla public license{_V}2(?: 0)?"),
    ("ms-pl", "microsoft", "ms pl", r"microsoft public license"),
    ("ms-rl", "microsoft", "ms rl", r"microsoft reciprocal license"),
    ("mulan-2.0", "mulan", "mulanpsl 2 0", rf"mulan (?:psl|permissive software license)(?:{_V}2)?"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("nasa-1.3", "nasa", "nasa 1 3", rf"nasa open source agreement(?:{_V}1 3)?"),
    ("npl-1.1", "netscape", "npl 1 1", rf"netscape public license(?:{_V}1 1)?"),
    ("odbl-1.0", "open", "odbl 1 0", rf"open (?:data commons open )?database license(?:{_V}1(?: 0)?)?"),
    ("odc-by-1.0", "open", "odc by 1 0", r"open data commons attribution license"),
    ("pddl-1.0", "dedication", "pddl 1 0", r"public domain dedication and license"),
    ("ofl-1.1", "font", "ofl 1 1", rf"(?:sil )?open font license(?:{_V}1 1)?"),
    ("oldap-2.8", "openldap", "oldap 2 8", rf"openldap public license(?:{_V}2 8)?"),
    ("openssl", "openssl", "openssl", r"openssl license"),
    ("osl-3.0", "open", "osl 3 0", rf"open software license(?:{_V}3(?: 0)?)?"),
    ("php-3.01", "php", "php 3 01", rf"php license(?:{_V}3 01)?"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("psf-2.0", "python", "psf 2 0", rf"python software foundation license(?:{_V}2)?"),
    ("qpl-1.0", "q public", "qpl 1 0", rf"q public license(?:{_V}1(?: 0)?)?"),
    ("rpl-1.5", "reciprocal", "rpl 1 5", rf"reciprocal public license(?:{_V}1 5)?"),
    ("ruby", "ruby", "ruby", r"ruby license"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat license"),
    ("sspl-1.0", "server", "sspl 1 0", rf"server side public license(?:{_V}1)?"),
    ("spl-1.0", "sun", "spl 1 0", rf"sun public license(?:{_V}1(?: 0)?)?"),
    ("unicode", "unicode", "unicode dfs 2016", r"unicode (?:inc )?license agreement"),
    ("unlicense", "unlicense", "unlicense", r"the unlicense"),
    ("upl-1.0", "universal", "upl 1 0", r"universal permissive license"),
    ("vim", "vim", "vim", r"vim license"),
    ("vsl-1.0", "vovida", "vsl 1 0", r"vovida software license"),
    ("w3c", "w3c", "w3c", r"w3c software (?:notice and )?license"),
    ("wtfpl", "you want to", "wtfpl", r"do what the f\w+ you want to public license"),
    ("x11", "x11", "x11", r"x11 license"),
    ("zlib", "zlib", "zlib", r"zlib license"),
    ("zpl-2.1", "zope", "zpl 2 1", rf"zope public license(?:{_V}2 1)?"),
]

#: Single signatures: label, tier, keyword, regex over the normal form.
SIGNATURES: list[tuple[str, int, str, str]] = [
    ("mit", NOTICE, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", NOTICE, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", NOTICE, "endorse", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    ("bsd-2-clause", NOTICE, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", NOTICE, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", NOTICE, "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", NOTICE, "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", NOTICE, "redistribute", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", NOTICE, "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-2.0-or-later", NOTICE, "general", r"gnu general public license .{0,80}?either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", NOTICE, "general", r"gnu general public license .{0,80}?either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", NOTICE, "general", r"lesser general public license .{0,80}?either version 2 1 of the license or at your option any later version"),
    ("mpl-2.0", NOTICE, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", NOTICE, "eclipse", r"made available under the terms of the eclipse public license"),
    ("unlicense", NOTICE, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", NOTICE, "license", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("zlib", NOTICE, "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("bsl-1.0", NOTICE, "boost", r"distributed under the boost software license version 1 0"),
    ("ofl-1.1", NOTICE, "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("cc-by", NOTICE, "commons", r"licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international)? license"),
    ("cc-by-sa", NOTICE, "commons", r"licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? license"),
    ("cc-by-nc", NOTICE, "commons", r"licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)? license"),
    ("cc-by", TAG, "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", TAG, "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", TAG, "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", TAG, "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", TAG, "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", TAG, "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1.0", TAG, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("apache-2.0", TAG, "apache", r"apache org licenses license 2 0"),
    ("gpl", TAG, "gnu", r"gnu org (?:copyleft|licenses) gpl(?: html)?"),
    ("lgpl", TAG, "gnu", r"gnu org (?:copyleft|licenses) lgpl(?: html)?"),
    ("mit", TAG, "opensource", r"opensource org licenses mit(?: license)?"),
    ("public-domain", NAME, "public", r"(?:released (?:in)?to|placed in|in|dedicated to) the public domain"),
    ("proprietary", NAME, "proprietary", r"proprietary and confidential"),
    ("proprietary", NAME, "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution) .{0,60}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", NAME, "written", r"without (?:the )?(?:prior |express )+written (?:permission|consent)"),
    ("gpl", NAME, "gpl", r"(?:gnu )?gpl(?: v)? ?[123](?: 0)?(?: or later|\+)?"),
    ("lgpl", NAME, "lgpl", r"(?:gnu )?lgpl(?: v)? ?[23](?: [01])?(?: or later|\+)?"),
    ("agpl", NAME, "agpl", r"(?:gnu )?agpl(?: v)? ?3(?: 0)?(?: or later|\+)?"),
    ("lgpl", NAME, "lesser", r"gnu lesser general public license"),
    ("agpl", NAME, "affero", r"gnu affero general public license"),
    ("bsd", NAME, "bsd", r"bsd(?: style)? license"),
    ("mit", NAME, "mit", r"(?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?mit(?: license)?"),
    ("apache", NAME, "apache", r"apache license"),
    ("mpl", NAME, "mozilla", r"mozilla public license"),
    ("epl", NAME, "eclipse", r"eclipse public license"),
    ("cc", NAME, "commons", r"creative commons(?: licen[sc]e)?"),
    ("copyright", HINT, "copyright", r"copyright(?: c)?(?: by)? (?:19|20)\d\d"),
    ("copyright", HINT, "copyright", r"all content (?:is )?copyright"),
    ("licensed", HINT, "licensed", r"licensed under"),
    ("licensed", HINT, "license", r"see (?:the )?license(?: file)? for (?:more )?(?:details|information)"),
]


def rules() -> list[tuple[int, str, int, str, str]]:
    """Ordered rules: (order, label, tier, keyword, regex); each family gives a tag, a name and a notice."""
    out = [*SIGNATURES]
    for label, keyword, tag, name in FAMILIES:
        head = tag.split("(")[0].split()[0]
        out.append((label, NOTICE, keyword, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}"))
        out.append((label, TAG, head, rf"spdx license identifier {tag}(?: only| or later)?"))
        out.append((label, TAG, head, rf"license {tag}(?: only| or later)?"))
        out.append((label, NAME, keyword, name))
    return [(i, *r) for i, r in enumerate(out)]


def gate_of(key: str) -> str:
    """What a lower-case normal form must contain for a rule of this keyword to be tried; every match holds it."""
    return f" {key} " if len(key) <= 4 and key not in STEMS else f" {key}"


def _normal(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _starts_with(phrase: str):
    # the space after the phrase is gone where another phrase follows at once
    return lambda piece: piece.rlike(f"(?i)^{phrase}( |$)")


def _found(normal: Column, low: Column, book: list[tuple[int, str, int, str, str]]) -> Column:
    """Intervals of all matches of the rules whose keyword the text holds.

    A keyword's rules are first tried together, by one constant regex that is compiled once; only where one of
    them matches are they told apart, by regexes that are compiled for the text.
    """
    kind = "array<struct<i:int,label:string,tier:int,rx:string>>"
    groups: dict[str, list[dict]] = {}
    for i, label, tier, key, rx in book:
        groups.setdefault(gate_of(key), []).append({"i": i, "label": label, "tier": tier, "rx": rx})
    some = []
    for gate, rows in groups.items():
        whole = "(?i)(?<= )(?:" + "|".join(f"(?:{r['rx']})" for r in rows) + ")(?= )"
        table = F.from_json(F.lit(json.dumps([r | {"rx": f"(?i)(?<= )(?:{r['rx']})(?= )"} for r in rows])), kind)  # folded to a constant
        some.append(F.when(F.contains(low, F.lit(gate)) & normal.rlike(whole), table).otherwise(F.array().cast(kind)))
    tried = F.flatten(F.array(*some))

    def spans(r: Column) -> Column:
        gaps = F.transform(F.split(normal, r["rx"]), lambda s: F.length(s))
        sizes = F.transform(F.regexp_extract_all(normal, r["rx"], F.lit(0)), lambda s: F.length(s))
        # running ends: gap + match after match
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
        walk = F.aggregate(
            F.arrays_zip(gaps.alias("g"), sizes.alias("s")), start,
            lambda acc, x: F.when(x["s"].isNull(), acc).otherwise(F.struct(
                (acc["at"] + x["g"] + x["s"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("a"), (acc["at"] + x["g"] + x["s"]).alias("b")))).alias("out"),
            )),
        )
        return F.transform(walk["out"], lambda p: F.struct(
            p["a"].alias("a"), (-p["b"]).alias("nb"), (-r["tier"]).alias("nt"), r["i"].alias("i"), r["label"].alias("label")))

    return F.flatten(F.transform(tried, spans))


def _kept(found: Column) -> Column:
    """Findings not contained in one of the same or a higher tier; one sweep by start, longest first."""
    tiers = sorted(CONFIDENCE)  # a tier's mark is the furthest end among it and all higher tiers
    start = F.struct(*[F.lit(-1).alias(f"t{t}") for t in tiers], F.array().cast("array<struct<label:string,tier:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end, tier = -x["nb"], -x["nt"]
        mark = F.coalesce(*[F.when(tier == t, acc[f"t{t}"]) for t in tiers])
        return F.struct(
            *[F.when(tier >= t, F.greatest(acc[f"t{t}"], end)).otherwise(acc[f"t{t}"]).alias(f"t{t}") for t in tiers],
            F.when(mark >= end, acc["out"]).otherwise(F.array_union(acc["out"], F.array(F.struct(x["label"].alias("label"), tier.alias("tier"))))).alias("out"),
        )

    return F.aggregate(F.array_sort(found), start, step)["out"]


def scan(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the findings kept."""
    book = rules()
    keys = sorted({k for *_, k, _ in book})
    gate = r"(?i) (?:" + "|".join(gate_of(k)[1:] for k in keys) + ")"
    starts = r"(?i) (?=(?:" + "|".join(BASE) + ") )"
    out = docs.select(F.col(doc_col).alias("doc_id"), _normal(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("normal"))
    out = out.select(
        "doc_id", "normal",
        F.when(F.length("normal") <= 2, F.lit(0).cast("bigint")).otherwise(_spaces(F.col("normal")) - 1).alias("n_words"),
        F.split("normal", starts).alias("pieces"),
        F.when(F.col("normal").rlike(gate), F.lower("normal")).alias("low"),
    )
    n = F.size("pieces") - 1
    empty = F.array().cast("array<struct<label:string,tier:int>>")
    has = [F.when(F.exists("pieces", _starts_with(phrase)), F.lit(label)) for phrase, label in BASE.items()]
    out = out.select(
        "doc_id", "n_words", n.cast("bigint").alias("n_base"),
        F.when(n > 0, _spaces(F.element_at("pieces", 1))).alias("first_word"),
        F.when(n > 0, F.col("n_words") - _spaces(F.element_at("pieces", -1))).alias("last_word"),
        F.when(n > 0, F.array_sort(F.array_compact(F.array(*has)))).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(F.col("low").isNotNull(), _kept(_found(F.col("normal"), F.col("low"), book))).otherwise(empty).alias("findings"),
    )
    sure = F.create_map(*[F.lit(x) for t, c in CONFIDENCE.items() for x in (t, c)])
    best = F.array_max(F.transform("findings", lambda f: sure[f["tier"]]))
    by_base = F.when(F.size("base") > 0, F.lit(CONFIDENCE[NAME])).otherwise(F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("findings", lambda f: f["label"]))), ",").alias("labels"),
        F.greatest(by_base, F.coalesce(best, F.lit(0.0))).alias("score"),
        "findings",
    )
