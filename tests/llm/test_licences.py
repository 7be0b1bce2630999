"""Licence notices with changed names, comment marks and inserted words are found; talk about licences is not."""

import random

from folioquarry.llm import license_index

FOUND = {
    "mit": """/*
 * Copyright (c) 2019 A. Person <a@b.org>
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice (including the next
 * paragraph) shall be included in all copies or substantial portions of the
 * Software.
 */""",
    "gpl-3": """# Frobnicate is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "apache-2": """Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0 (the "License");
    you may not use this file except in compliance with the License. You may obtain a copy of the License at
        https://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,""",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice. 3. Neither the name of Example Incorporated nor the
    names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to",
    "cc-by-sa": "Except where noted, this book is released under a Creative Commons Attribution-ShareAlike 4.0 International license.",
    "cc-by-nc-nd": "(c) 2021. Distributed under CC BY-NC-ND 4.0",
    "agpl-3": "The server is available under the GNU Affero General Public License.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}
CLEAN = [
    "The GNU General Public License has been discussed at length by many authors.",
    "All people reserve the right to free software, free of charge, without any permission being granted.",
    "Source and binary stars are seen in many forms, with or without modification of the image.",
    "You may not use this file. The license of the driver was lost.",
    "",
]


def test_notices_as_they_stand_in_files(spark):
    rows = [(i, text) for i, text in enumerate([*FOUND.values(), *CLEAN])]
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(FOUND):
        assert label in got[i].method_labels.split(","), label
        assert 0.75 <= got[i].score <= 1
    assert [got[i].labels for i in range(len(FOUND), len(rows))] == [""] * len(CLEAN)


def test_inserted_and_lost_words(spark):
    rng = random.Random(8)
    rows, want = [], {}
    whole = [(i, label, words.split()) for i, (label, words, keys) in enumerate(license_index.TEMPLATES) if len(words.split()) > 30]
    for i, label, words in whole:
        keys = license_index.TEMPLATES[i][2]
        safe = [j for j in range(len(words)) if not any(words[max(0, j - len(k.split())) : j + len(k.split())] and k in " ".join(words[max(0, j - len(k.split())) : j + len(k.split())]) for k in keys)]
        for j in sorted(rng.sample(safe, min(len(safe), 3)), reverse=True):
            words = [*words[:j], f"put{j}", *words[j:]]
        rows.append((i, " ".join(["x"] * rng.randint(0, 30) + words)))
        want[i] = label
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in want if want[i] not in got[i].method_labels.split(",")] == []
