"""Section trees and the training rows of sectioned texts."""

import json

from sparkloom.operators.sections import section_rows, sections, task_rows

TEXT = """before

# A law
lead
## One (title)
first
```
# no heading
```
### Deep ###
x
## Two (deleted)
gone
### Under
kept
# B
"""


def test_tree():
    rows = sections(TEXT, "(deleted)")
    assert [r[:4] for r in rows] == [(0, 0, None, ""), (1, 1, None, "A law"), (2, 2, 1, "One (title)"), (3, 3, 2, "Deep"), (5, 3, 4, "Under"), (6, 1, None, "B")]
    assert [r[7] for r in rows] == ["before", "lead", "first\n```\n# no heading\n```", "x", "kept", ""]
    spans = {r[3]: r[4:7] for r in rows}
    assert spans["A law"] == (2, 4, 15) and spans["One (title)"] == (4, 9, 11) and spans["Deep"] == (9, 11, 11) and spans["B"] == (15, 17, 17)
    assert sections(None) == [] == sections("\n \n") and [r[7] for r in sections("no headings\nat all")] == ["no headings\nat all"]
    assert [r[3] for r in sections("#no\n####### no\n## yes")] == ["", "yes"]


def test_rows_of_tasks(spark):
    long = "word " * 50
    texts = {
        1: f"# Case\n## holding\nthe holding is \"quoted\" and long\n## body\n{long}",
        2: "# Case\n## holding\nshort\n## body\nshort",
        3: "# Law\n" + "\n".join(f"## Art {k}\n{long}" for k in range(11)),
        4: "plain " * 60,
        5: "too short",
        6: None,
    }
    tree = section_rows(spark.createDataFrame(list(texts.items()), "k long, text string"), "k", "text")
    got = {}
    for r in task_rows(tree, "k", "holding", "body").collect():
        got.setdefault(r.k, []).append((r.kind, r.part, r.instruction, r.response))
    assert sorted(got) == [1, 3, 4]
    kinds = {x[0]: x for x in got[1]}
    assert json.loads(kinds["extract"][3]) == {"name": "Case", "holding": 'the holding is "quoted" and long'} and kinds["summary"][2].startswith("Summarise.\n\nword")
    assert sorted(x[1] for x in got[3]) == list(range(1, 9)) and all(x[0] == "section" for x in got[3])
    assert [(x[0], x[2]) for x in got[4]] == [("whole", texts[4].strip())]
