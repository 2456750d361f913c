"""What a language model is told, and the rules and templates that a new knowledge base starts with.

A knowledge base may hold a template for each kind of page (schema/templates/KIND.md) and rules (schema/references/*.md); what it holds goes into the prompt,
what it lacks is taken from here.
"""

from __future__ import annotations

from pathlib import Path

from .notes import system_prompt

NOTE = """You turn one raw text into one note of a knowledge base.

* Answer with the note alone: front matter between lines of three dashes, then Markdown. No fences around it.
* Write in the language of the raw text.
* State only what the raw text says. Addresses, authors and dates that it does not give stay empty; under `## Source` write "Not provided in source." for them.
* `key_claims` is a list of full sentences. Its first entry names the central terms with their other names, abbreviations and translations; every claim gives a term's other names where it is used, for readers search by any of them.
* Mark what has a name as 【name|type】, the type being one of 人物, 组织, 产品, 技术, 概念, 项目, 地点.
* Keep quotations word for word, and say of a conclusion of your own that it is one.

The note has this form:
"""
PLAN = """You plan the pages of a knowledge base from its notes. Answer with a JSON list and nothing else. Each entry has type (concept, comparison or decision), title, slug (short, of
lower-case letters and dashes), description (one sentence) and sources (the paths of the notes it rests on, as given). Take a title that exists where a page on that subject exists. Plan no page that only one sentence of one note bears out."""
PAGE = """You write one page of a knowledge base from its notes. Answer with the whole page: front matter between lines of three dashes, then Markdown, without fences. Everything it says stands in the
page as it was or in the notes; where notes disagree, give both sides and name them. The page has this form:
"""
STEPS = {
    "create": "Write a new {type} page.",
    "append": "Add to this {type} page what the new notes say and it does not. Leave what stands there as it is, and its order.",
    "rewrite": "This {type} page has grown by additions. Put it in order: join what belongs together, work in the new notes, lose no fact.",
}
GAPS = "From these notes on one topic, say what they cover, which questions they leave open, and which sources would answer them. Answer in Markdown."

_HEAD = "---\ntitle: ...\ntype: {0}\ndescription: one sentence\ntags: []\nsources: []\ntimestamp: YYYY-MM-DD\n"
TEMPLATES = {
    "source-note": _HEAD.format("source-note") + 'resource: ""\nkey_claims:\n  - "..."\n---\n\n## Summary\n\n## Key points\n\n## Terms\n\n## Source\n\n- Author:\n- Published:\n- Imported:\n',
    "concept": _HEAD.format("concept") + "related_to: []\n---\n\n## What it is\n\n## How it works\n\n## Where it applies\n\n## Open questions\n",
    "comparison": _HEAD.format("comparison") + "related_to: []\n---\n\n## What is compared\n\n| | A | B |\n| --- | --- | --- |\n\n## Differences that matter\n\n## Which to choose when\n",
    "decision": _HEAD.format("decision") + "related_to: []\n---\n\n## Question\n\n## Choices\n\n## Decision and reasons\n\n## Consequences\n",
}
REFERENCES = {
    "page-types": "A source note restates one raw text. A concept explains one subject from several notes. A comparison sets subjects against each other. A decision records a choice and its reasons.\n",
    "citation-rules": "Every page names its sources by path in `sources`. A wiki link `[[Title]]` names another page. Relations go into `related_to`, `supports`, `contradicts` and `supersedes`.\n",
}


def bundled() -> dict[str, str]:
    """path, text of the files that a new knowledge base has under schema/."""
    out = {f"schema/templates/{k}.md": t for k, t in TEMPLATES.items()} | {f"schema/references/{k}.md": f"# {k.replace('-', ' ').capitalize()}\n\n{t}" for k, t in REFERENCES.items()}
    return out | {"schema/README.md": "# Rules\n\nPages declare title, type, sources and timestamp. Templates and rules beside this file go into the prompts.\n"}


def for_kind(root: str, task: str, kind: str) -> str:
    """A task with the knowledge base's template of a kind of page and its rules."""
    at = Path(root, "schema/templates", f"{kind}.md")
    template = at.read_text() if at.is_file() else TEMPLATES.get(kind, TEMPLATES["concept"])
    rules = {p.stem: p.read_text() for p in Path(root, "schema/references").glob("*.md")}
    return system_prompt(f"{task}\n{template}", rules)


def page_prompt(step: str, kind: str, title: str, description: str, page: str, notes: list[tuple[str, str]]) -> str:
    """What the model gets to write a page from: the step, the page as it stands, and the notes (path, text)."""
    parts = [STEPS[step].format(type=kind), f"Title: {title}\nDescription: {description}"]
    if page:
        parts.append(f"The page as it stands:\n\n{page}")
    parts += [f"Note {path}:\n\n{text}" for path, text in notes]
    return "\n\n".join(parts)
