"""Operator 5: licence scan over a positional rare-token index, in DataFrame functions only.

The index holds, for each licence template, the places of its rarest words (highest inverse document frequency over
the templates).  Each word of a text is looked up; a posting fixes where the template would lie, all of its rare words
are looked for round their places along that offset, and the share of their weight that is there is the score.  The
further a word is from the posting the more words may have been put in or left out between, so a notice with changed
names, dates or comment marks is found.  A template is a label if its score reaches ``threshold`` and its mandatory
key phrases stand word for word where it lies.  Base phrases are found beside it by the same lookup of one word of each.

The index is made of the fixed templates below (some hundred, with at most ``RARE`` rows each), so it is broadcast.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows give one result
each; an empty table gives no rows; only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.textsql import words_of

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, notice or text of the licence as words, its mandatory key phrases.
NOTICES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""",
        ["permission is hereby granted free of charge", "sell copies of the software", "copies or substantial portions of the software"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mit-0", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        the software is provided as is without warranty of any kind""", ["whom the software is furnished to do so the software is provided as is"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted", "permission notice appear in all copies"]),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties", ["with or without fee is hereby granted the software is provided"]),
    ("bsd-2", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by""", ["redistribution and use in source and binary forms", "materials provided with the distribution this software"]),
    ("bsd-3", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above
        copyright notice redistributions in binary form must reproduce the above copyright notice neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""", ["redistribution and use in source and binary forms", "endorse or promote products derived from this software"]),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by", ["all advertising materials mentioning features or use of this software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis""",
        ["except in compliance with the license", "unless required by applicable law or agreed to in writing"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "www apache org licenses license 2 0"]),
    ("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
        or at your option any later version""", ["the gnu general public license as published by", "either version 2 of the license"]),
    ("gpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
        or at your option any later version""", ["the gnu general public license as published by", "either version 3 of the license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["the gnu general public license as published by"]),
    ("lgpl-2.1", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
        of the license or at your option any later version""", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("lgpl-3", """you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
        or at your option any later version""", ["gnu lesser general public license", "version 3 of the license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", """you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
        or at your option any later version""", ["gnu affero general public license"]),
    ("gfdl", """permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation
        with no invariant sections no front cover texts and no back cover texts""", ["gnu free documentation license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["the mozilla public license v 2 0"]),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl", ["the mozilla public license version 1 1"]),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", ["the eclipse public license v1 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ["the eclipse public license 2 0"]),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ["common development and distribution license"]),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ["the eupl version 1 2"]),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", ["license establishes the terms under which a given free software package"]),
    ("boost-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display
        distribute execute and transmit the software and to prepare derivative works of the software""", ["any person or organization obtaining a copy", "use reproduce display distribute execute and transmit"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone
        to use this software for any purpose including commercial applications and to alter it and redistribute it freely""", ["including commercial applications and to alter it and redistribute it freely"]),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled
        binary for any purpose commercial or non commercial and by any means""", ["free and unencumbered software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license", ["do what the fuck you want to"]),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return", ["you can buy me a beer in return"]),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal with the software without restriction neither the names of nor the names of its contributors may be used to endorse or promote products derived from this software", ["to deal with the software without restriction", "endorse or promote products"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["without fee and without a written agreement is hereby granted"]),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation", ["this permission notice appear in supporting documentation"]),
    ("psf-2", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation", ["python software foundation"]),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit http www openssl org", ["software developed by the openssl project"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at http scripts sil org ofl", ["sil open font license"]),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software", ["this license governs use of the accompanying software"]),
    ("cc0-1", """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and
        neighboring rights to the extent allowed by law""", ["dedicated the work to the public domain by waiving"]),
    ("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("all-rights-reserved", "all rights reserved", ["rights reserved"]),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", ["no part of this publication may be reproduced"]),
]
# Label and names by which a statement names the licence.
NAMES = [
    ("mit", ["mit license", "expat license"]),
    ("isc", ["isc license"]),
    ("bsd-2", ["bsd 2 clause license", "simplified bsd license"]),
    ("bsd-3", ["bsd 3 clause license", "new bsd license", "modified bsd license"]),
    ("apache-2", ["apache license version 2", "apache license 2 0", "apache 2 0 license"]),
    ("gpl-2", ["gnu general public license version 2", "gnu gpl version 2", "gplv2", "gnu general public license v2"]),
    ("gpl-3", ["gnu general public license version 3", "gnu gpl version 3", "gplv3", "gnu general public license v3"]),
    ("lgpl-2.1", ["gnu lesser general public license version 2 1", "lgplv2 1"]),
    ("lgpl-3", ["gnu lesser general public license version 3", "lgplv3"]),
    ("agpl-3", ["gnu affero general public license version 3", "gnu affero general public license", "agplv3"]),
    ("gfdl", ["gnu free documentation license"]),
    ("mpl-2", ["mozilla public license version 2 0", "mozilla public license 2 0"]),
    ("epl-2", ["eclipse public license version 2 0", "eclipse public license 2 0"]),
    ("cddl-1", ["common development and distribution license"]),
    ("eupl-1.2", ["european union public licence"]),
    ("artistic-2", ["artistic license 2 0"]),
    ("boost-1", ["boost software license version 1 0", "boost software license"]),
    ("zlib", ["zlib license"]),
    ("ofl-1.1", ["sil open font license"]),
    ("ms-pl", ["microsoft public license"]),
    ("cc0-1", ["creative commons cc0 1 0 universal", "cc0 1 0"]),
    ("cc-by", ["creative commons attribution 4 0 international", "creative commons attribution 3 0", "cc by 4 0", "cc by 3 0"]),
    ("cc-by-sa", ["creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0", "creative commons attribution sharealike 3 0", "cc by sa 4 0", "cc by sa 3 0"]),
    ("cc-by-nd", ["creative commons attribution noderivatives 4 0 international", "creative commons attribution noderivs 3 0", "cc by nd 4 0"]),
    ("cc-by-nc", ["creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 3 0", "cc by nc 4 0", "cc by nc 3 0"]),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike 4 0 international", "creative commons attribution noncommercial sharealike 3 0", "cc by nc sa 4 0", "cc by nc sa 3 0"]),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivatives 4 0 international", "creative commons attribution noncommercial noderivs 3 0", "cc by nc nd 4 0"]),
]
#: Words that make a name a statement, with room between them and the name for an article or two.
STATEMENTS = ("licensed under", "released under", "distributed under", "available under", "under the terms of")
#: Words of a template that its index entry holds at most: those of highest inverse document frequency.
RARE = 14
#: Words of a notice that are looked up: the rarest, as far as they are no function words; of a name, which has to stand whole, one.
ANCHORS = 5
FUNCTION_WORDS = frozenset("a all an and any are as at be but by can do for from how if in is it may no nor not of on one or so some that the then there this to we what where whom with you your".split())
#: A word in more than this share of the templates is not rare.
COMMON = 0.35
#: Words that may be put in or left out round a posting, and how many further ones for each so many words from it.
SLACK, EACH = 3, 5


def all_templates() -> list[tuple[str, str, list[str]]]:
    """Label, words and key phrases of the notices, and of the statements made of the names."""
    made = [(label, " ".join(text.split()), keys) for label, text, keys in NOTICES]
    return made + [(label, name, [name]) for label, names in NAMES for name in names]


TEMPLATES = all_templates()


def build_index(templates: list[tuple[str, str, list[str]]] = TEMPLATES, rare: int = RARE) -> list[dict]:
    """A row for each anchor of each template, its rarest words: word, label, q (its place), size, names (whether it is a mere name), keys, and all rare words with weight, place and slack from this one.

    Words of one or two letters are taken only where a template has no longer rare word, and common ones only where it has no rare word at all.
    """
    split = [t[1].split() for t in templates]
    frequency = Counter(w for ws in split for w in set(ws))
    idf = {w: math.log(len(templates) / n) for w, n in frequency.items()}
    rows = []
    for (label, text, phrases), ws in zip(templates, split, strict=True):
        few = {w for w in ws if frequency[w] <= COMMON * len(templates)}
        ranked = sorted({w for w in few if len(w) > 2} or few or set(ws), key=lambda w: (-idf[w], ws.index(w)))[:rare]
        names = phrases == [text]
        places = [(i, w) for i, w in enumerate(ws) if w in ranked]
        if any(f" {p} " not in f" {text} " for p in phrases):
            raise ValueError(f"a key phrase does not stand in its template: {text!r}")
        weight = sum(idf[w] for _, w in places)
        if not weight:
            raise ValueError(f"no word tells this template from the others: {text!r}")
        best = [w for w in ranked if w not in FUNCTION_WORDS] or ranked
        for q, w in places:
            if w not in best[: 1 if names else ANCHORS]:
                continue
            near = [{"place": i, "word": x, "weight": idf[x] / weight, "slack": 0 if names or i == q else SLACK + abs(i - q) // EACH} for i, x in places]
            rows.append({"word": w, "label": label, "q": q, "size": len(ws), "names": names, "keys": list(phrases), "rare": near})
    return rows


INDEX_TYPE = "word string, label string, q int, size int, names boolean, keys array<string>, rare array<struct<place:int,word:string,weight:double,slack:int>>"


def _part(words: Column, low: Column, high: Column) -> Column:
    """The words from one place up to another, as far as there are any."""
    low = F.greatest(low, F.lit(0))
    return F.slice(words, low + 1, F.greatest(high - low, F.lit(0)))


def _said(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _base_place(words: Column, word: Column, at: Column, phrase: str) -> Column:
    """Where the phrase starts, if the word at a place is its least common one and the others stand around it; else null."""
    parts = phrase.split()
    pivot = max(range(len(parts)), key=lambda i: (parts[i] not in ("the", "under", "by", "version"), parts.count(parts[i]) == 1, -i))
    rest = [F.coalesce(F.get(words, at - pivot + i) == p, F.lit(False)) for i, p in enumerate(parts) if i != pivot]
    ok = word == parts[pivot]
    for r in rest:
        ok = ok & r
    return F.when(ok, at - pivot)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, list[str]]] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and method_labels for each row."""
    index = F.broadcast(docs.sparkSession.createDataFrame(build_index(templates), INDEX_TYPE))
    text = F.col(f"`{text_col}`").cast("string")
    key = ["id", "text_hash"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    # one more row for each text, at place -1 with the word "", so that texts without matches stay
    each = rows.select(*key, "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("n", "word")).withColumn("at", F.col("n") - 1)
    met = each.join(index, "word", "left")
    base = [_base_place(F.col("w"), F.col("word"), F.col("at"), p).alias(f"b{i}") for i, p in enumerate(BASE)]
    w, offset = F.col("w"), F.col("at") - F.col("q")
    around = lambda x: _part(w, offset + x["place"] - x["slack"], offset + x["place"] + x["slack"] + 1)
    score = F.aggregate("rare", F.lit(0.0), lambda s, x: s + F.when(F.array_contains(around(x), x["word"]), x["weight"]).otherwise(0.0))
    room = F.when(F.col("names"), 0).otherwise(SLACK + (F.col("size") / EACH).cast("int"))
    lies = _said(_part(w, offset - room, offset + F.col("size") + room))
    keyed = F.forall("keys", lambda p: F.contains(lies, F.concat(F.lit(" "), p, F.lit(" "))))
    before = _said(_part(w, offset - 6, offset))  # a mere name counts where words before it state the licence
    stated = ~F.col("names") | F.exists(F.array(*[F.lit(f" {x} ") for x in STATEMENTS]), lambda x: F.contains(before, x))
    places = [f"b{i}" for i in range(len(BASE))]
    # this filter stays within generated code, so only the few rows that pass carry their words on
    met = met.select(*key, "w", "at", *base, "label", "q", "size", "names", "rare", "keys").filter(" or ".join(["at < 0", "label is not null", *[f"{p} is not null" for p in places]]))
    part = met.select(*key, F.when(F.col("at") < 0, F.size("w")).alias("n_words"), *places, "label", F.when(F.col("label").isNotNull(), score).alias("score"), F.when(F.col("label").isNotNull(), keyed & stated).alias("keyed"))
    label = F.when((F.col("score") >= threshold) & F.col("keyed"), F.col("label"))
    starts = [F.collect_set(p).alias(p) for p in places]
    per = part.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set(label).alias("method"), F.max(F.when(label.isNotNull(), F.col("score"))).alias("score"), *starts)
    every = F.concat(*places)
    base_labels = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(BASE[x])) for p, x in zip(places, BASE, strict=True)]))
    per = per.withColumn("base", base_labels).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return per.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "method")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"),
        F.array_join(F.array_sort("method"), ",").alias("method_labels"),
    )
