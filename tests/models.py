"""Plain scanning models of the text rules, for whole-table and random comparisons."""

TRIPLES = ('"""', "'''")


def _scan(text, match):
    """``text`` without every stretch for which ``match(text, i)`` gives a length."""
    out, i = [], 0
    while i < len(text):
        n = match(text, i)
        if not n:
            out.append(text[i])
        i += n or 1
    return "".join(out)


def _python_fence(text, i):
    if text[i:i + 9].lower() != "```python":
        return 0
    return 10 if text[i + 9:i + 10] == "\n" else 9


def _any_fence(text, i):
    return 3 if text[i:i + 3] == "```" else 4 if text[i:i + 4] == "\n```" else 0


def clean_model(raw):
    at = [i for i in range(len(raw)) if raw[i:i + 3] in TRIPLES]
    later = [j for j in at if j >= at[0] + 3]
    doc = raw[at[0] + 3:later[0]] if later else raw
    doc = _scan(_scan(doc.strip(), _python_fence), _any_fence).strip()
    for mark in "\"'":
        while doc.startswith(mark):
            doc = doc[1:]
        while doc.endswith(mark):
            doc = doc[:-1]
    return doc


def block_model(doc, indent):
    text = f'"""\n{doc}\n"""'
    rows = [(" " * 4 + r if r and not r.isspace() else " " * 4) for r in text.split("\n")]
    return "".join(f"{indent}{r}\n" for r in rows) + "\n"


def indent_model(line):
    n = 0
    while n < len(line) and line[n].isspace():
        n += 1
    return line[:n]
