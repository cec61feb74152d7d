"""Languages with braces: definitions, imports, calls and comments from one scanner and a table of heads for each.

Comments and literals are blanked out first, so that what is left can be searched over line ends and braces can be
matched. A head (what opens a definition) may span lines; its body is what the next brace on its level holds, so that
definitions nest: the innermost one around another is its parent, and a call belongs to the innermost function around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: What is no code: comments, strings, characters. Languages differ in single quotes, back quotes and raw strings.
COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
DOUBLE = r'"(?:\\.|[^"\\\n])*"'
CHARACTER = r"'(?:\\(?:u\{?[0-9A-Fa-f]+\}?|x[0-9A-Fa-f]{2}|.)|[^'\\\n])'"
LITERALS = {
    "rust": r'\bb?r(?P<h>#*)".*?"(?P=h)|' + r'"(?:\\.|[^"\\])*"' + "|" + CHARACTER, "go": r"`[^`]*`|" + DOUBLE + "|" + CHARACTER, "typescript": r"`(?:\\.|[^`\\])*`|" + DOUBLE + r"|'(?:\\.|[^'\\\n])*'",
    "java": r'""".*?"""|' + DOUBLE + "|" + CHARACTER, "kotlin": r'""".*?"""|' + DOUBLE + "|" + CHARACTER, "csharp": r'[$@]*@[$@]*"(?:""|[^"])*"|""".*?"""|' + DOUBLE + "|" + CHARACTER, "cpp": r'R"(?P<h>\w*)\(.*?\)(?P=h)"|' + DOUBLE + "|" + CHARACTER,
}
SAME = {"javascript": "typescript", "c": "cpp"}

ANGLE = r"<[^<>{};]*(?:<[^<>{};]*(?:<[^<>{};]*>[^<>{};]*)*>[^<>{};]*)*>"
ANGLES = f"(?:{ANGLE})?"
ROUND = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
MODIFIERS = r"(?:@\w+(?:\([^()]*\))?\s+)*(?P<v>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|synchronized|default|native|extern|unsafe|new|data|open|inner|enum|value|annotation|suspend|inline|operator|infix|tailrec|external|const|lateinit|export|declare)\s+)*)"
#: Where a member may begin: on a line of its own, or behind what ends another.
START = r"(?:^|(?<=[{};]))[ \t]*"
TYPE = r"(?:[\w.:]+\s*" + ANGLES + r"(?:\[\s*,*\s*\])*[?&*]*)"
#: Heads of definitions: kind, pattern up to the name (n) and behind it. `member` stands for what only a class holds.
HEADS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\b(?:default\s+|async\s+|unsafe\s+|const\s+|extern\s+)*fn\s+(?P<n>\w+)"), ("struct", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\b(?:struct|union)\s+(?P<n>\w+)"), ("enum", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\benum\s+(?P<n>\w+)"),
        ("trait", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\b(?:unsafe\s+)?trait\s+(?P<n>\w+)"), ("impl", r"\bimpl\b\s*" + ANGLES + r"\s*(?:!?[\w:]+\s*" + ANGLES + r"\s+for\s+)?&?(?:\w+::)*(?P<n>\w+)"), ("type_alias", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\btype\s+(?P<n>\w+)"),
        ("constant", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\b(?:const|static)\s+(?:mut\s+)?(?P<n>[A-Z_][A-Z0-9_]*)\s*:"), ("module", r"(?P<v>\bpub(?:\s*\([^)]*\))?\s+)?\bmod\s+(?P<n>\w+)"),
    ],
    "go": [
        ("method", r"^func\s+\((?:\s*\w+\s+)?\*?\s*(?P<o>\w+)" + r"(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)"), ("function", r"^func\s+(?P<n>\w+)"), ("struct", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type_alias", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)=?\s*[\w*\[(]"),
    ],
    "typescript": [
        ("function", r"(?P<v>\bexport\s+)?(?:default\s+)?\b(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)"), ("class", r"(?P<v>\bexport\s+)?(?:default\s+)?\b(?:declare\s+)?(?:abstract\s+)?class\s+(?P<n>\w+)"), ("interface", r"(?P<v>\bexport\s+)?\b(?:declare\s+)?interface\s+(?P<n>\w+)"),
        ("enum", r"(?P<v>\bexport\s+)?\b(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>\w+)"), ("type_alias", r"(?P<v>\bexport\s+)?\btype\s+(?P<n>\w+)\s*" + ANGLES + r"\s*="),
        ("function", r"(?P<v>\bexport\s+)?\b(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:" + ANGLES + r"\s*" + ROUND + r"\s*(?::[^=;{}]+)?|\w+\s*)=>"), ("function", r"(?P<v>\bexport\s+)?\b(?:const|let|var)\s+(?P<n>\w+)\s*=\s*(?:async\s+)?function\b"),
        ("variable", r"(?P<v>\bexport\s+)?\b(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=;{}]+)?=(?![=>])"),
        ("member", START + MODIFIERS + r"(?:get\s+|set\s+|\*\s*)?(?P<n>[#\w$]+)\s*\??\s*" + ANGLES + r"\s*" + ROUND + r"\s*(?::[^;{}=]+)?(?=\{)"),
    ],
    "java": [
        ("class", MODIFIERS + r"\b(?:class|record)\s+(?P<n>\w+)"), ("interface", MODIFIERS + r"(?:@\s*)?\binterface\s+(?P<n>\w+)"), ("enum", MODIFIERS + r"\benum\s+(?P<n>\w+)"),
        ("member", START + MODIFIERS + f"(?:{ANGLE}\\s*)?" + r"(?P<t>" + TYPE + r"\s+)?(?P<n>\w+)\s*" + ROUND + r"\s*(?:throws\s+[\w.,\s]+)?(?=[{;])"),
        ("field", START + MODIFIERS + r"(?P<t>" + TYPE + r"\s+)(?P<n>\w+)\s*(?:\[\s*\]\s*)*(?==[^=]|;)"),
    ],
    "csharp": [
        ("class", MODIFIERS + r"\b(?:class|record(?:\s+class|\s+struct)?)\s+(?P<n>\w+)"), ("struct", MODIFIERS + r"\b(?:ref\s+)?struct\s+(?P<n>\w+)"), ("interface", MODIFIERS + r"\binterface\s+(?P<n>\w+)"), ("enum", MODIFIERS + r"\benum\s+(?P<n>\w+)"),
        ("module", r"\bnamespace\s+(?P<n>[\w.]+)"), ("member", START + MODIFIERS + r"(?P<t>" + TYPE + r"\s+)?(?P<n>\w+)\s*" + ANGLES + r"\s*" + ROUND + r"\s*(?::\s*(?:base|this)\s*" + ROUND + r"\s*)?(?:where[^{;]+)?(?=\{|=>|;)"),
        ("field", START + MODIFIERS + r"(?P<t>" + TYPE + r"\s+)(?P<n>\w+)\s*(?=\{\s*(?:(?:private|protected|internal|public)\s+)?(?:get|set|init)\b|=>)"),
    ],
    "kotlin": [
        ("interface", MODIFIERS + r"\b(?:fun\s+)?interface\s+(?P<n>\w+)"), ("class", MODIFIERS + r"\bclass\s+(?P<n>\w+)"), ("class", MODIFIERS + r"\bobject\s+(?P<n>\w+)"), ("function", MODIFIERS + r"\bfun\s+" + ANGLES + r"\s*(?:[\w.]+" + ANGLES + r"\??\.)?(?P<n>\w+)\s*(?=\()"),
        ("variable", START + MODIFIERS + r"\b(?:val|var)\s+(?:[\w.]+\.)?(?P<n>\w+)[ \t]*(?::[^=\n,)]+)?(?=[ \t]*(?:=|by\b|\n|;|\Z))"),
    ],
    "cpp": [
        ("class", r"(?<!enum )\bclass\s+(?:[A-Z_]+\s+)?(?P<n>\w+)(?:\s+final)?\s*(?=[{:])"), ("struct", r"\b(?:struct|union)\s+(?P<n>\w+)(?:\s+final)?\s*(?=[{:])"), ("enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<n>\w+)[^;{}()]*(?=\{)"), ("module", r"\bnamespace\s+(?P<n>[\w:]+)\s*(?=\{)"),
        ("constant", r"^[ \t]*#\s*define\s+(?P<n>\w+)"), ("type_alias", r"\btypedef\s+[^;{}]*?\b(?P<n>\w+)\s*(?=;)"), ("type_alias", r"\busing\s+(?P<n>\w+)\s*="),
        ("any", START + r"(?!(?:public|private|protected)\s*:)(?:template\s*<[^{};]*>\s*)?(?P<t>(?:[\w:<>,~*&\[\]]+\s+)*[\w:<>,~*&\[\]]*?)(?P<n>(?:\w+::)*~?\w+)\s*" + ROUND + r"\s*(?:const\b\s*|noexcept\b\s*|override\b\s*|final\b\s*|->\s*[\w:<>*& ]+)*(?::[^;{}]*?)?(?=\{)"),
    ],
}
RULES = {k: [(kind, re.compile(p, re.M)) for kind, p in own] for k, own in HEADS.items()}
MASKS = {k: re.compile(f"(?P<c>{COMMENTS})|{p}", re.S) for k, p in LITERALS.items()}
NOT_NAMES = frozenset("if for while switch return catch else do try match loop when synchronized using lock fixed foreach new throw await yield typeof sizeof function fn func fun in and or not super this constructor_ case delete assert unless".split())
CALL = re.compile(r"(?P<dot>\.|->|::)?\s*\b(?P<n>[A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>;{}]*(?:<[^<>]*>[^<>]*)*>|<[\w\s,.\[\]?]*>)?\(")
HOLDERS = {"class", "struct", "interface", "trait", "impl", "enum"}
SPECIFIER = re.compile(r"\b(public|private|protected)\s*:(?!:)")
MARKED = re.compile(r"(?i)(todo|fixme|note|hack|xxx)\b")
LICENCE = re.compile(r"(?i)licen[cs]e|copyright|spdx|all rights reserved|generated|do not edit")


@dataclass
class Scan:
    """A file without comments and literals (same places, same lines), its comments, and where its lines begin."""

    text: str
    code: str
    comments: list[dict] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def line(self, place: int) -> int:
        return bisect_right(self.starts, place)


def scanned(text: str, language: str) -> Scan:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    out = Scan(text, text, [], starts)

    def blank(m: re.Match) -> str:
        if m["c"] is not None:
            out.comments.append({"raw": m[0], "at": m.start(), "line": out.line(m.start()), "end_line": out.line(max(m.start(), m.end() - 1))})
            return re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]

    out.code = MASKS[language].sub(blank, text)
    return out


def cleaned(raw: str) -> str:
    """A comment's words, without its signs and the stars of its lines."""
    body = re.sub(r"\A/\*+!?|\*+/\Z|\A//+!?", "", raw)
    return " ".join(x for x in (re.sub(r"^\s*\*+ ?|^\s*//+!? ?", "", y).strip() for y in body.split("\n")) if x)


def grouped(scan: Scan) -> list[dict]:
    """Comments as text with first and last line; line comments that follow each other are one, but for marked ones."""
    out: list[dict] = []
    for c in scan.comments:
        text = cleaned(c["raw"])
        alone = not scan.text[scan.starts[c["line"] - 1] : c["at"]].strip()
        last = out[-1] if out else None
        if last and alone and last["alone"] and c["raw"].startswith("//") and last["raw"].startswith("//") and last["end_line"] == c["line"] - 1 and not MARKED.match(text) and c["raw"][:3] == last["raw"][:3]:
            last |= {"text": f"{last['text']} {text}".strip(), "end_line": c["end_line"]}
        else:
            out.append({"text": text, "line": c["line"], "end_line": c["end_line"], "alone": alone, "raw": c["raw"]})
    return [c for c in out if c["text"]]


def closing(code: str, start: int) -> int:
    """The place of the brace that closes the one at start; the end where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1


def body_of(code: str, place: int, language: str) -> tuple[int, int]:
    """Where the body of a head that ends at place begins, and where the definition ends; -1 without a body."""
    depth = 0
    for m in re.compile(r"[(){}\[\];]|=>|=(?!=)|\n").finditer(code, place):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth > 0:
            continue
        elif c == "{":
            return m.start(), closing(code, m.start())
        elif c in (";", "}"):
            return -1, m.start() if c == ";" else m.start() - 1
        elif c in ("=", "=>") and language in ("kotlin", "csharp"):
            end = code.find("\n" if language == "kotlin" else ";", m.end())
            end = len(code) - 1 if end < 0 else end
            brace = code.find("{", m.end(), end)
            return (m.start(), closing(code, brace)) if brace >= 0 else (m.start(), end)
        elif c == "\n" and (language == "kotlin" or (language == "go" and code[place : m.start()].strip())) and not re.match(r"\s*[{:.=]", code[m.end() :]):
            return -1, m.start()
    return -1, len(code) - 1


def definitions(scan: Scan, file_id: str, language: str) -> list[dict]:
    """Symbols with the places of their heads and bodies, in order, each with its parent."""
    code, found = scan.code, []
    for kind, rule in RULES[language]:
        for m in rule.finditer(code):
            name = m["n"].rsplit("::", 1)[-1]
            if kind in ("member", "any", "field") and (name in NOT_NAMES or (m.groupdict().get("t") or "").split(" ")[0].strip() in NOT_NAMES):
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if kind == "constant":
                end = code.find("\n" if language == "cpp" else ";", m.end())
                begin, end = -1, len(code) - 1 if end < 0 else end
            elif kind in ("variable", "field"):
                begin, end = -1, m.end()
            elif kind == "type_alias":
                begin, end = -1, max(m.end() - 1, code.find("\n" if language == "go" else ";", m.end()))
            else:
                begin, end = body_of(code, m.end(), language)
            found.append({"kind": kind, "name": name, "at": at, "head": m.end(), "begin": begin, "to": end, "public": m.groupdict().get("v") or "", "owner": m.groupdict().get("o") or (m["n"].rsplit("::", 2)[-2] if "::" in m["n"] else None), "typed": bool((m.groupdict().get("t") or "").strip())})
    found.sort(key=lambda s: (s["at"], s["kind"] in ("variable", "field"), -s["to"]))
    out, around, seen = [], [], set()
    for s in found:
        while around and around[-1]["to"] < s["at"]:
            around.pop()
        top = around[-1] if around else None
        holder = top is not None and top["kind"] in HOLDERS
        if s["kind"] == "member":
            if not holder or not (s["typed"] or s["name"] == top["name"] or language == "typescript"):
                continue
            s["kind"] = "function" if s["name"] in (top["name"], "constructor") else "method"
        elif s["kind"] == "field" or (s["kind"] == "variable" and language == "kotlin" and top is not None):
            if not holder:
                continue
            s["kind"] = "variable"
        elif s["kind"] == "variable":
            if top is not None:
                continue
        elif s["kind"] == "any":
            if top is not None and top["kind"] not in HOLDERS | {"module"}:
                continue
            s["kind"] = "method" if holder or s["owner"] else "function"
        elif s["kind"] == "function" and holder:
            s["kind"] = "method"
        line = scan.line(s["at"])
        key = (line, s["name"])
        if key in seen:
            continue
        seen.add(key)
        s |= {"id": f"s:{file_id}:{line}:{s['name']}", "start": line, "end": max(line, scan.line(s["to"])), "parent": top["id"] if top else None, "top": top}
        s["exported"] = exported(s, scan, language)
        s["signature"] = " ".join(scan.text[s["at"] : s["begin"] if s["begin"] >= 0 else s["to"] + 1].split())[:300].rstrip("{ ")
        out.append(s)
        if s["begin"] >= 0:
            around.append(s)
    types = {s["name"]: s["id"] for s in reversed(out) if s["kind"] in HOLDERS - {"impl"}}
    for s in out:  # methods outside their type's body belong to it where the file has it
        if s["owner"] in types and (s["parent"] is None or language == "cpp"):
            s["parent"] = types[s["owner"]]
        elif s["kind"] == "impl" and s["name"] in types and s["parent"] is None:
            s["parent"] = types[s["name"]]
    return out


def exported(s: dict, scan: Scan, language: str) -> bool:
    """Whether other files may use a symbol, by what its language says in front of it."""
    said = s["public"].split()
    if language == "go":
        return s["name"][:1].isupper()
    if language == "kotlin":
        return not {"private", "internal"} & set(said)
    if language in ("java", "csharp"):
        return "public" in said
    if language == "rust":
        return "pub" in said  # pub(crate) is one word and is not
    if language == "typescript":
        return "export" in said
    if s["top"] is not None and s["top"]["kind"] in ("class", "struct"):  # the last access specifier in front, else the kind's own
        marks = SPECIFIER.findall(scan.code, s["top"]["begin"], s["at"])
        return marks[-1] != "private" if marks else s["top"]["kind"] == "struct"
    return True


def use_tree(path: str) -> list[tuple[str, list[str]]]:
    """A use path with groups as (path, names), a row for each group of plain names."""
    path = "".join(re.sub(r"\bas\s+\w+", "", path).split())
    if "{" not in path:
        head, _, last = path.rpartition("::")
        return [(path, [last] if head else [])]
    head, _, rest = path.partition("{")
    head, inner = head.rstrip(":"), rest[: rest.rfind("}")] if "}" in rest else rest
    parts, depth, now = [], 0, ""
    for c in inner + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    plain = [p for p in parts if p and "::" not in p]
    out = [(head, plain)] if plain else []
    return out + [(f"{head}::{a}" if head else a, n) for p in parts if "::" in p for a, n in use_tree(p)]


def imports(scan: Scan, language: str) -> list[dict]:
    out: list[dict] = []

    def add(place: int, path: str, names: list[str]) -> None:
        out.append({"import_path": path, "names": [n for n in names if n], "line": scan.line(place)})

    listed = lambda x: [re.split(r"\s+as\s+|:", n.strip())[0].strip() for n in x.split(",") if n.strip()]
    text, code = scan.text, scan.code
    if language == "rust":
        for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
            for path, names in use_tree(m[1]):
                add(m.start(1), path.lstrip(":"), names)
    elif language == "go":
        for m in re.finditer(r"^import\s*(\((?P<all>[^)]*)\)|[^\n]*)", code, re.M):
            for q in re.finditer(r'"([^"\n]+)"', text[m.start() : m.end()]):
                add(m.start() + q.start(), q[1], [])
    elif language == "typescript":
        for m in re.finditer(r"^\s*(?:import|export)\b(?P<w>[^;'\"]*?)(?:\bfrom\b\s*)?(?P<q>['\"])", code, re.M):
            if "=" in m["w"] or (m[0].lstrip().startswith("export") and "from" not in m[0]):
                continue
            end = text.find(m["q"], m.end())
            group = re.search(r"\{([^}]*)\}", m["w"])
            plain = re.sub(r"\*\s*as\s+|\{[^}]*\}|\bfrom\b|\btype\b", " ", m["w"])
            names = listed(plain) + (listed(group[1].replace("type ", "")) if group else [])
            add(m.start("q"), text[m.end() : end], names)
        for m in re.finditer(r"(?:\b(?:const|let|var)\s+(?P<w>\{[^}]*\}|\w+)\s*=\s*)?\b(?:require|import)\s*\(\s*(?P<q>['\"])", code):
            end = text.find(m["q"], m.end())
            add(m.start("q"), text[m.end() : end], listed((m["w"] or "").strip("{}")))
    elif language in ("java", "kotlin"):
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)", code, re.M):
            add(m.start(1), m[1].removesuffix(".*"), [] if m[1].endswith("*") else [m[1].rsplit(".", 1)[-1]])
    elif language == "csharp":
        for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", code, re.M):
            add(m.start(1), m[1], [])
    else:
        for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', text, re.M):
            add(m.start(1), m[1], [])
    return out


def calls(scan: Scan, symbols: list[dict]) -> list[dict]:
    """Calls within functions: the line the innermost one begins at, the callee, whether it is called on something."""
    bodies = [s for s in symbols if s["kind"] in ("function", "method") and s["begin"] >= 0]
    heads = {s["at"] + scan.code[s["at"] : s["head"]].rfind(s["name"]) for s in symbols}
    out, around, rest = [], [], iter(sorted(bodies, key=lambda s: s["begin"]))
    coming = next(rest, None)
    for m in CALL.finditer(scan.code):
        place = m.start("n")
        while coming and coming["begin"] <= place:
            around.append(coming)
            coming = next(rest, None)
        while around and around[-1]["to"] < place:
            around.pop()
        inside = next((s for s in reversed(around) if s["to"] >= place), None)
        if inside and (m["dot"] or m["n"] not in NOT_NAMES) and place not in heads:
            out.append({"caller_line": inside["start"], "callee": m["n"], "is_method": m["dot"] in (".", "->")})
    return out


def attach_docs(scan: Scan, symbols: list[dict], comments: list[dict]) -> None:
    """Give symbols the comment that ends on the line in front of them, annotations between passed over."""
    by_end = {c["end_line"]: c for c in comments if c["alone"]}
    lines = scan.code.split("\n")
    for s in symbols:
        line = s["start"] - 1
        while line > 0 and re.match(r"\s*(?:#!?\[|@\w|\[\w)", lines[line - 1]):
            line -= 1
        said = by_end.get(line)
        text = said["text"] if said and not MARKED.match(said["text"]) else None
        s["doc"] = shortened(text, 120) if text else None


def shortened(text: str, most: int) -> str:
    one = text.split(". ", 1)[0].strip()
    return one if len(one) <= most else one[: most - 3] + "..."


def module_doc(scan: Scan, comments: list[dict], language: str) -> str | None:
    """What a file's head says it is for: the first comment in front of all code (Rust: of //! or /*!), unless it is a licence."""
    first = len(scan.code) - len(scan.code.lstrip())
    top = [c for c in comments if c["line"] <= scan.line(min(first, max(len(scan.code) - 1, 0)))]
    if language == "rust":
        top = [c for c in top if c["raw"].startswith(("//!", "/*!"))]
    said = next((c["text"] for c in top if not LICENCE.search(c["text"])), None)
    return shortened(said, 160) if said else None
