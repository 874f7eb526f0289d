"""License signatures that literal names do not reach."""

import random

import pytest

from proofloom.llm import licenses

CASES = [
    ("SPDX-License-Identifier: MIT", "mit"), ("licensed under MIT", "mit"), ("licensed under the MIT.", "mit"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: Zlib", "zlib"),
    ("SPDX-License-Identifier: Unlicense", "unlicense"), ("SPDX-License-Identifier: PostgreSQL", "postgresql"), ("GPL v2", "gpl"), ("GPLv3", "gpl"), ("a BSD licence", "bsd"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: (LGPL-2.1-only)", "lgpl"), ("Mozilla Public Licence, version 2.0", "mpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("License: Apache-2.0", "apache"), ("Lizenz: GPLv3", "gpl"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache"), ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl"), ("under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("CC-BY-4.0", "cc-by"), ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This program is free software; you can redistribute it and/or modify", "gpl"), ("GNU Lesser General Public Licence v2.1 or later", "lgpl"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
    ("the two-clause BSD license", "bsd"), ("Do What The Fuck You Want To Public License", "wtfpl"), ("may not be copied or distributed without the express written permission", "proprietary"),
    ("die Lizenz mit der Nummer", None), ("a license python programmers hold", None), ("she studied at MIT", None), ("the vim editor, python and zlib", None), ("postgresql under load", None), ("licensed under mitigation rules", None),
]


# The widened wordings keep the label of the base phrase they contain; "gpl" then stands beside a longer name's own label.
@pytest.mark.parametrize("text, label", CASES)
def test_signatures(text, label):
    raw = text.encode().lower()
    assert {d.rule.label for d in licenses.detect(raw, licenses.words_of(raw)) if not d.rule.base} == ({label} if label else set())


def plain_settle(found):
    """The longest of the highest priority first; what lies inside one that stayed goes, if not of a base rule."""
    kept = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label)):
        if d.rule.base or not any(k.start <= d.start and d.end <= k.end for k in kept if not k.rule.base or k.rule.label == d.rule.label):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule.label))


@pytest.mark.parametrize("seed", range(20))
def test_overlaps_settle_as_pair_by_pair(seed):
    rng = random.Random(seed)
    base = [licenses.Rule(label, None, 100, 1.0, frozenset(), base=True) for label in "ab"]
    others = [licenses.Rule(rng.choice("abc"), None, rng.choice([40, 80, 90]), 1.0, frozenset()) for _ in range(6)]
    found = [licenses.Detection(a, a + rng.randrange(1, 30), rng.choice(base + others)) for a in (rng.randrange(60) for _ in range(60))]
    assert licenses.settle(found) == plain_settle(found)


def test_priority_and_containment():
    raw = b"spdx-license-identifier: gpl-2.0-or-later and gpl 2.0"
    found = licenses.detect(raw, licenses.words_of(raw))
    assert [(raw[d.start : d.end], d.rule.priority) for d in found] == [(b"spdx-license-identifier: gpl-2.0-or-later", 92), (b"gpl 2.0", 45)]


def plain_detections(raw):
    """Every rule on the whole text, without keywords."""
    return plain_settle([licenses.Detection(m.start(), m.end(), r) for r in licenses.ordered_rules() for m in r.pattern.finditer(raw)])


def test_keywords_open_every_rule_that_matches():
    texts = [t for t, _ in CASES] + ["MIT License, the GNU General Public License and Apache License 2.0; all rights reserved. " * 3, "", "mit " * 2000 + "license"]
    for text in texts:
        raw = text.encode().lower()
        facts = lambda found: [(d.start, d.end, d.rule.label, d.rule.priority) for d in found]
        assert facts(licenses.detect(raw, licenses.words_of(raw))) == facts(plain_detections(raw))


def test_rules_are_many_and_open_by_words_of_their_own():
    assert len(licenses.ordered_rules()) > 300
    assert all(r.keywords for r in licenses.ordered_rules())
