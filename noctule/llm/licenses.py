"""Licence recognition by sentences and ordered rules.

Texts are cut into sentences, normalised, mapped to identifiers of known
licence sentences, and the identifier sequence is consumed by ordered rules.
Everything is a projection on the row's own text: no join, no shuffle.  Only
texts with an anchor word (every known sentence has one) are cut at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that short grants and tags give to licences, normalised (lower case, letters and digits, single blanks).
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "MIT": ("mit license", "mit"),
    "ISC": ("isc license", "isc"),
    "BSD-2-Clause": ("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "0BSD": ("0bsd", "bsd zero clause license", "zero clause bsd license"),
    "Zlib": ("zlib license", "zlib"),
    "BSL-1.0": ("boost software license version 1 0", "bsl 1 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0", "epl 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3 0 only"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gpl 2 0 or later"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gpl 3 0 or later"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl 2 1 only"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgpl 3 0 only"),
    "LGPL-2.1-or-later": ("gnu lesser general public license version 2 1 or later", "lgpl 2 1 or later"),
    "LGPL-3.0-or-later": ("gnu lesser general public license version 3 or later", "lgpl 3 0 or later"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only"),
    "AGPL-3.0-or-later": ("gnu affero general public license version 3 or later", "agpl 3 0 or later"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international license"),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0"),
    "Unlicense": ("unlicense",),
}
#: Known licence sentences, normalised.  A sentence with a cut (``.!?;:`` before white space)
#: within is here in the pieces the cutter yields.
SENTENCES = {
    "ApacheLicensedThe": "licensed under apache license version 2 0 the license",
    "ApacheUse": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "ApacheCopyAt": "you may obtain a copy of the license at",
    "ApacheAddress": "http www apache org licenses license 2 0",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "ApacheHead": "apache license",
    "ApacheDated": "version 2 0 january 2004",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ZeroGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "Unencumbered": "this is free and unencumbered software released into the public domain",
    "Cc0Waived": "waived all copyright and related or neighboring rights",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ProgramFree": "this program is free software",
    "LibraryFree": "this library is free software",
    "ProgramHope": "this program is distributed in the hope that it will be useful but without any warranty",
    "LibraryHope": "this library is distributed in the hope that it will be useful but without any warranty",
    "NotImplied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "Gpl2Dated": "version 2 june 1991",
    "Gpl3Dated": "version 3 29 june 2007",
    "Agpl3Dated": "version 3 19 november 2007",
    "Lgpl21Dated": "version 2 1 february 1999",
    "MplTerms": "this source code form is subject to the terms of the mozilla public license v",
    "MplNumber": "2 0",
    "MplObtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "MplObtainHttps": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "MplSubject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "EplMade": "licensed under eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "EplMadeHttps": "licensed under eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "AllRights": "copyright all rights reserved",
    "Reserved": "all rights reserved",
    "Notice": "copyright",
}
#: Short grants and tags of every name; a name alone on a line is a heading.
for _license, _names in NAMES.items():
    for _k, _name in enumerate(_names):
        SENTENCES |= {f"Grant{_k}-{_license}": f"licensed under {_name}"}
        SENTENCES |= {f"Tag{_k}-{_license}": f"spdx license identifier {_name}"}
        SENTENCES |= {f"Head{_k}-{_license}": _name} if _name.endswith("license") and not _name.startswith("a ") else {}
#: The licences of one publisher, whose notices are alike: name, title, versions, dates of their texts.
FAMILIES = (("GPL", "gnu general public license", {"2.0": "Gpl2Dated", "3.0": "Gpl3Dated"}), ("LGPL", "gnu lesser general public license", {"2.1": "Lgpl21Dated", "3.0": "Gpl3Dated"}),
            ("AGPL", "gnu affero general public license", {"3.0": "Agpl3Dated"}))
NOTICES = []
for _family, _title, _versions in FAMILIES:
    _terms = f"you can redistribute it and or modify it under the terms of the {_title}"
    SENTENCES |= {f"{_family}See": f"see the {_title} for more details", f"{_family}Head": _title, f"{_family}Terms": f"{_terms} as published by the free software foundation"}
    for _version, _dated in _versions.items():
        _n = _version.removesuffix(".0").replace(".", " ")
        _later, _id = f"either version {_n} of the license or at your option any later version", f"{_family}{_n.replace(' ', '')}"
        SENTENCES |= {f"OrLater{_n.replace(' ', '')}": _later, f"{_id}Terms": f"{_terms} as published by the free software foundation {_later}",
                      f"{_id}Only": f"{_terms} version {_n} as published by the free software foundation"}
        for _what in ("Program", "Library"):
            SENTENCES |= {f"{_id}{_what}": f"this {_what.lower()} is free software {_terms} as published by the free software foundation {_later}"}
            _rests = ((f"{_what}Hope", "NotImplied", f"{_family}See"), ("GplHope", f"{_family}See"), ())
            NOTICES += [(f"{_family}-{_version}-or-later", (*head, *rest)) for rest in _rests for head in (
                (f"{_what}Free", f"{_family}Terms", f"OrLater{_n.replace(' ', '')}"), (f"{_what}Free", f"{_id}Terms"), (f"{_id}{_what}",))]
            NOTICES += [(f"{_family}-{_version}", (f"{_what}Free", f"{_id}Only", *rest)) for rest in _rests]
        NOTICES += [(f"{_family}-{_version}", (f"{_family}Head", _dated))]
#: Rules in order, the longer before the shorter; each consumes its identifiers.
RULES = (
    *(("Apache-2.0", (first, "ApacheUse", *copy, "ApacheAsIs", "ApacheSee")) for copy in (("ApacheCopy",), ("ApacheCopyAt", "ApacheAddress")) for first in ("ApacheLicensedThe", "Grant0-Apache-2.0")),
    ("Apache-2.0", ("ApacheHead", "ApacheDated")),
    ("Apache-2.0", ("ApacheLicensedThe",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    *NOTICES,
    ("MPL-2.0", ("MplTerms", "MplNumber", "MplObtain")),
    ("MPL-2.0", ("MplTerms", "MplNumber", "MplObtainHttps")),
    ("MPL-2.0", ("MplTerms", "MplNumber")),
    ("MPL-2.0", ("MplSubject", "MplObtain")),
    ("MPL-2.0", ("MplSubject", "MplObtainHttps")),
    ("MPL-2.0", ("MplSubject",)),
    ("EPL-2.0", ("EplMade",)),
    ("EPL-2.0", ("EplMadeHttps",)),
    ("Unlicense", ("Unencumbered",)),
    ("CC0-1.0", ("Cc0Waived",)),
    *((name.split("-", 1)[1], (name,)) for name in SENTENCES if name[:3] in ("Gra", "Tag", "Hea") and "-" in name),
    ("Proprietary", ("AllRights",)),
    ("Proprietary", ("Notice", "Reserved")),
    ("Proprietary", ("Reserved",)),
)
#: Grants that stand below a copyright notice own its "all rights reserved": they are tried with it first.
RULES = tuple((name, before + ids) for name, ids in RULES for before in ((("AllRights",), ("Reserved",), ()) if len(ids) > 1 and "Reserved" not in ids or {"IscGrant", "ZeroGrant", "ZlibGrant", "BoostGrant"} & {*ids} else ((),)))
#: Every known sentence has one of these; texts without them are not cut.
ANCHOR = r"licen[sc]|copyright|permission|redistribut|software|warrant|rights reserved|mpl|gpl|^\W*version [23]|^2\W0\W*$"
#: A tag's value stays with it.
TAG = r"(?i)(SPDX-License-Identifier:)\s+"
#: Short grants are reduced to what they say of whom they name, waivers to what they waive, copyright lines to what they claim.
GRANT = (r"^(?:(?:this|the|all|our) (?:[a-z0-9]+ ){1,6}?(?:is|are) |it is )?(?:made )?(?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?", "licensed under ")
WAIVER = (r"^to the extent possible under law .* waived all copyright and related or neighboring rights to .*$", "waived all copyright and related or neighboring rights")
HOLDER = (r"^copyright .*all rights reserved$", "copyright all rights reserved"), (r"^copyright (?!all rights reserved$).*$", "copyright")


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    for pattern, put in (GRANT, WAIVER, *HOLDER):
        plain = F.regexp_replace(plain, pattern, put)
    return plain


def identifiers(text: Column) -> tuple[Column, Column]:
    """Identifiers of the known sentences in order of the text: by line, and with wrapped lines joined."""
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))

    def found(joined: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(joined, TAG, "$1"), r"([.!?;:])\s+", "$1\n"), "\n"), lambda s: F.lower(s).rlike(ANCHOR))
        return F.filter(F.transform(parts, lambda s: F.try_element_at(known, normalised(s))), lambda x: x.isNotNull())

    return found(text), found(F.regexp_replace(text, r"\n(?!\s*\n)", " "))


def scan(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """Add licenses (names by rule order, ``|`` between, '' if none), n_known and n_unmatched (long).

    Sentences end at ``.!?;:`` before white space.  A line break ends a sentence
    too, unless joining wrapped lines (not paragraphs) identifies more of them,
    notices of rights counting last.
    Rules are tried in order on the sequence left by those before them, each
    name is given once.  NULL and empty texts have no licence; repeated rows
    are scanned alike; columns of the added names are replaced.
    """
    value = F.col(f"`{text}`")
    none = F.array().cast("array<string>")
    by_line, joined = identifiers(value)
    asked = F.coalesce(F.lower(value).rlike(ANCHOR), F.lit(False))
    added = ("licenses", "n_known", "n_unmatched")
    # the row's own columns are packed, so that none can be taken for one of the steps
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.when(asked, F.struct(by_line.alias("a"), joined.alias("b"))).alias("_pair"))
    # a notice in two lines does not outweigh the grant below it, whose lines are wrapped
    most = lambda c: F.struct(F.size(F.filter(c, lambda x: ~x.isin("Notice", "Reserved", "AllRights"))), F.size(c))
    out = both.withColumn("_ids", F.coalesce(F.when(most("_pair.b") > most("_pair.a"), F.col("_pair.b")).otherwise(F.col("_pair.a")), none))
    # "||" between identifiers, so that each owns its bars and neighbours can be consumed alike
    left = F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|"))
    tried = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(ids) + "|").alias("own")) for name, ids in rules))
    eaten = F.aggregate(tried, F.struct(left.alias("left"), none.alias("names")), lambda x, rule: F.when(F.contains(x["left"], rule["own"]), F.struct(
        F.replace(x["left"], rule["own"], F.lit("|.|")).alias("left"), F.concat(x["names"], F.array(rule["name"])).alias("names"))).otherwise(x))
    out = out.withColumn("_eaten", F.when(F.size("_ids") > 0, eaten))
    hit = F.array_join(F.array_distinct("_eaten.names"), "|")
    rest = F.size(F.filter(F.split("_eaten.left", r"\|+"), lambda x: ~x.isin("", ".", "Notice")))
    rest = F.when(F.col("_eaten").isNotNull(), rest)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), F.coalesce(hit, F.lit("")).alias("licenses"),
                      F.size("_ids").cast("long").alias("n_known"), F.coalesce(rest, F.lit(0)).cast("long").alias("n_unmatched"))
