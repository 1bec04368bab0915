"""Parsers of source text that need brackets, blocks or scopes. Each takes (path, content) and returns rows.

files.extract runs them as Arrow batches on the executors; nothing here touches Spark.
"""

from __future__ import annotations

import re

PAIRS = {"(": ")", "{": "}", "[": "]"}


def blank(source: str, hash_comments: bool = False) -> str:
    """source with comments and the insides of strings as spaces, so that offsets stay and brackets can be counted."""
    comment = r"\#[^\n]*" if hash_comments else r"//[^\n]*|/\*.*?\*/"
    strings = r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|' if hash_comments else ""
    token = re.compile(rf"{strings}\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|{comment}", re.S)

    def hide(m: re.Match) -> str:
        t = m.group()
        if t[0] in "\"'":
            return t[0] + re.sub(r"[^\n]", " ", t[1:-1]) + t[-1]
        return re.sub(r"[^\n]", " ", t)

    return token.sub(hide, source)


def closing(source: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the end; source is blanked."""
    stack = []
    for i in range(at, len(source)):
        c = source[i]
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i
    return len(source)


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts of text between commas outside brackets and angle brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == by and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [p.strip() for p in out if p.strip()]


def join_url(*parts: str) -> str:
    url = "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))
    return re.sub(r"/+", "/", url)


# Java

_JAVA_TYPE = r"[\w$][\w$.]*(?:\s*<[^;={}()]*>)?(?:\[\])*"
_JAVA_CLASS = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_JAVA_FIELD = re.compile(rf"((?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:private|protected|public|final|static|transient|volatile)\s+)*({_JAVA_TYPE})\s+(\w+)\s*(?==|;)")
_JAVA_METHOD = re.compile(rf"((?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)*)(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?({_JAVA_TYPE})\s+(\w+)\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)\s*(?:throws\s+[\w.,\s]+)?([{{;])")
_NOT_TYPES = {"return", "new", "else", "throw", "case", "package", "import", "instanceof", "assert"}


def java_class(source: str) -> dict | None:
    """The first type of a Java file: kind, name, annotations, fields and methods of its top level."""
    clean = blank(source)
    m = _JAVA_CLASS.search(clean)
    if not m:
        return None
    opened = clean.find("{", m.end())
    if opened < 0:
        return None
    end = closing(clean, opened)
    head_from = max(clean.rfind(";", 0, m.start()), clean.rfind("}", 0, m.start())) + 1
    out = {"kind": m.group(1), "name": m.group(2), "head": source[head_from:opened], "fields": [], "methods": []}
    at = opened + 1
    while at < end:
        member = _JAVA_METHOD.match(clean, _skip(clean, at))
        field = None if member else _JAVA_FIELD.match(clean, _skip(clean, at))
        if member and member.group(2).split()[0] not in _NOT_TYPES:
            stop = closing(clean, member.end() - 1) if member.group(5) == "{" else member.end() - 1
            cut = lambda g: source[member.start(g) : member.end(g)]  # noqa: E731, B023
            out["methods"].append({"name": member.group(3), "returns": cut(2), "annotations": cut(1), "args": cut(4), "body": clean[member.end() : stop] if member.group(5) == "{" else "", "pos": member.start()})
            at = stop + 1
        elif field and field.group(2) not in _NOT_TYPES:
            out["fields"].append({"name": field.group(3), "type": field.group(2).strip(), "annotations": source[field.start(1) : field.end(1)], "pos": field.start()})
            at = clean.find(";", field.end())
            at = end if at < 0 else at + 1
        else:  # anything else: over one statement or block
            nxt = re.compile(r"[;{]").search(clean, at)
            if not nxt or nxt.start() >= end:
                break
            at = nxt.end() if nxt.group() == ";" else closing(clean, nxt.start()) + 1
    return out


def _skip(text: str, at: int) -> int:
    m = re.compile(r"[\s;]*").match(text, at)
    return m.end() if m else at


def simple_type(kind: str) -> str:
    return re.sub(r"<.*", "", kind.strip(), flags=re.S).split(".")[-1].replace("[]", "").strip()


def java_package(source: str) -> str:
    m = re.search(r"^\s*package\s+([\w.]+)\s*;", source, re.M)
    return m.group(1) if m else ""


_MAPPING = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(((?:[^()]|\([^()]*\))*)\))?")


def _mapping(annotations: str) -> tuple[str, str] | None:
    m = _MAPPING.search(annotations)
    if not m:
        return None
    args = m.group(2) or ""
    path = re.search(r"(?:value|path)\s*=\s*\{?\s*\"([^\"]*)\"", args) or re.search(r"^\s*\{?\s*\"([^\"]*)\"", args)
    method = m.group(1).upper()
    if method == "REQUEST":
        said = re.search(r"RequestMethod\.(\w+)", args)
        method = said.group(1) if said else "GET"
    return method, path.group(1) if path else ""


def java_apis(path: str, source: str) -> list[tuple]:
    """(file, package, class, method, path, summary, pos): endpoints of a controller, its own path in front."""
    c = java_class(source)
    if not c or not re.search(r"@(Rest)?Controller\b", c["head"]):
        return []
    base = _mapping(c["head"])
    out = []
    for m in c["methods"]:
        own = _mapping(m["annotations"])
        if own:
            said = re.search(r"@(?:Operation\s*\([^)]*summary\s*=|ApiOperation\s*\(\s*(?:value\s*=)?)\s*\"([^\"]*)\"", m["annotations"])
            out.append((path, java_package(source), c["name"], own[0], join_url(base[1] if base else "", own[1]), said.group(1) if said else m["name"], m["pos"]))
    return out


def java_rpcs(path: str, source: str) -> list[tuple]:
    """(file, client, interface, method, http, path, pos): the methods of a Feign client."""
    c = java_class(source)
    mark = re.search(r"@FeignClient\s*\(((?:[^()]|\([^()]*\))*)\)", source)
    if not c or not mark:
        return []
    args = mark.group(1)
    named = re.search(r"\b(?:name|value)\s*=\s*\"?([\w.${}-]+)\"?", args) or re.search(r"^\s*\"([^\"]+)\"", args) or re.search(r"\bcontextId\s*=\s*\"([^\"]+)\"", args)
    base = re.search(r"\bpath\s*=\s*\"([^\"]*)\"", args)
    out = []
    for m in c["methods"]:
        own = _mapping(m["annotations"])
        if own:
            out.append((path, named.group(1) if named else c["name"], c["name"], m["name"], own[0], join_url(base.group(1) if base else "", own[1]), m["pos"]))
    return out


_RELATION = {"OneToOne": "one-to-one", "OneToMany": "one-to-many", "ManyToOne": "many-to-one", "ManyToMany": "many-to-many"}


def jpa_fields(path: str, source: str) -> list[tuple]:
    """(file, entity, table, name, type, column, nullable, pos): fields of a JPA entity."""
    c = java_class(source)
    if not c or not re.search(r"@Entity\b", c["head"]):
        return []
    named = re.search(r"@Table\s*\([^)]*name\s*=\s*\"([^\"]+)\"", c["head"])
    table = named.group(1) if named else re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c["name"]).lower()
    out = []
    for f in c["fields"]:
        if any(f"@{r}" in f["annotations"] for r in _RELATION) or "@Transient" in f["annotations"]:
            continue
        column = re.search(r"@Column\s*\([^)]*name\s*=\s*\"([^\"]+)\"", f["annotations"])
        null = not ("@Id" in f["annotations"] or re.search(r"nullable\s*=\s*false|@NotNull", f["annotations"]))
        out.append((path, c["name"], table, f["name"], f["type"], column.group(1) if column else None, null, f["pos"]))
    return out


def jpa_relations(path: str, source: str) -> list[tuple]:
    """(src, dst, kind, field, source, file, pos)"""
    c = java_class(source)
    if not c or not re.search(r"@Entity\b", c["head"]):
        return []
    out = []
    for f in c["fields"]:
        for mark, kind in _RELATION.items():
            if re.search(rf"@{mark}\b", f["annotations"]):
                inner = re.search(r"<\s*(?:[\w.]+\s*,\s*)?([\w.]+)\s*>", f["type"])
                out.append((c["name"], simple_type(inner.group(1) if inner else f["type"]), kind, f["name"], "jpa", path, f["pos"]))
    return out


def java_methods(path: str, source: str) -> list[tuple]:
    """(file, class, method, signature, annotations, pos)."""
    c = java_class(source)
    if not c:
        return []
    return [(path, c["name"], m["name"], f"{m['returns']} {m['name']}({m['args']})", re.findall(r"@\w+", m["annotations"]), m["pos"]) for m in c["methods"]]


def java_fields(path: str, source: str) -> list[tuple]:
    """(file, class, kind, name, type, pos)"""
    c = java_class(source)
    return [(path, c["name"], c["kind"], f["name"], simple_type(f["type"]), f["pos"]) for f in c["fields"]] if c else []


def java_calls(path: str, source: str) -> list[tuple]:
    """(file, class, method, receiver, called, pos): calls inside method bodies; this and bare calls have receiver "this"."""
    c = java_class(source)
    out = []
    for m in c["methods"] if c else []:
        for k, call in enumerate(re.finditer(r"(?:\b(\w+)\s*\.\s*)?\b([a-z]\w*)\s*\(", m["body"])):
            before = m["body"][: call.start()].rstrip()[-1:]
            if call.group(2) in {"if", "for", "while", "switch", "catch", "return", "super", "this", "synchronized", "throw", "assert"} or (before == "." and not call.group(1)) or before == "." or re.search(r"\bnew\s*$", m["body"][: call.start()]):
                continue
            out.append((path, c["name"], m["name"], call.group(1) or "this", call.group(2), k))
    return out


# Go

_GO_HTTP = re.compile(r"\b(\w+)\.(GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch|HandleFunc|Handle)\s*\(\s*\"([^\"]*)\"")
_GO_GROUP = re.compile(r"\b(\w+)\s*:?=\s*(\w+)\.(?:Group|Route)\s*\(\s*\"([^\"]*)\"")


def go_structs(path: str, source: str) -> list[tuple]:
    """(file, struct, field, type, tag, pos)"""
    clean = blank(source)
    out = []
    for m in re.finditer(r"\btype\s+(\w+)\s+struct\s*\{", clean):
        end = closing(clean, m.end() - 1)
        for k, line in enumerate(source[m.end() : end].split("\n")):
            f = re.match(r"\s*(\w+)\s+([\w.*\[\]{}]+)(?:\s+`([^`]*)`)?\s*(?://.*)?$", line)
            if f:
                out.append((path, m.group(1), f.group(1), f.group(2), f.group(3), k))
    return out


def go_routes(path: str, source: str) -> list[tuple]:
    """(file, kind, receiver, method, path, pos): routes and groups in order; net/http routes are GET.

    The prefix of a route is an as-of lookup over these rows, so it is left to the caller's window.
    """
    rows = [(m.start(), "group", m.group(1), "", m.group(3)) for m in _GO_GROUP.finditer(source)]
    for m in _GO_HTTP.finditer(source):
        verb = m.group(2).upper()
        rows.append((m.start(), "route", m.group(1), "GET" if verb.startswith("HANDLE") else verb, m.group(3)))
    return [(path, kind, who, method, url, pos) for pos, kind, who, method, url in sorted(rows)]


def go_calls(path: str, source: str) -> list[tuple]:
    """(file, function, receiver, called, pos): methods and the calls in their bodies."""
    clean = blank(source)
    out = []
    for m in re.finditer(r"\bfunc\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)\s*\([^{]*\{", clean):
        body = clean[m.end() : closing(clean, m.end() - 1)]
        name = f"{m.group(1)}.{m.group(2)}" if m.group(1) else m.group(2)
        calls = [(c.group(1), c.group(2)) for c in re.finditer(r"\b(\w+)\.(\w+)\s*\(", body)]
        out += [(path, name, a, b, k) for k, (a, b) in enumerate(calls)] or [(path, name, None, None, 0)]
    return out


# Python


def _blocks(source: str) -> list[tuple[int, int, str]]:
    """(line, indent, text) of lines that aren't blank; strings over several lines are hidden."""
    return [(n, len(line) - len(line.lstrip()), line) for n, line in enumerate(blank(source, True).split("\n")) if line.strip()]


def python_classes(path: str, source: str) -> list[tuple]:
    """(file, class, bases, field, type, pos): fields of pydantic, Django and SQLAlchemy classes."""
    lines, raw, out = _blocks(source), source.split("\n"), []
    for i, (n, indent, text) in enumerate(lines):
        m = re.match(r"\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", text)
        if not m:
            continue
        inner = None
        for k, deep, _ in lines[i + 1 :]:
            if deep <= indent:
                break
            inner = deep if inner is None else inner
            line = raw[k]
            if deep != inner:
                continue
            f = re.match(r"\s*(\w+)\s*:\s*([^=#]+?)\s*(?:=.*)?$", line) or re.match(r"\s*(\w+)\s*=\s*(?:\w+\.)?(\w*(?:Field|Column|ForeignKey|relationship|mapped_column))\s*\(", line)
            if f and f.group(1) not in {"return", "else", "try", "class", "def"}:
                out.append((path, m.group(1), m.group(2) or "", f.group(1), f.group(2).strip(), k))
    return out


def python_routes(path: str, source: str) -> list[tuple]:
    """(file, method, path, handler, pos): FastAPI and Flask decorators, Django and Tornado tables."""
    out, prefixes = [], {}
    for m in re.finditer(r"(\w+)\s*=\s*(?:APIRouter|Blueprint)\s*\(([^)]*)\)", source):
        p = re.search(r"(?:url_)?prefix\s*=\s*[\"']([^\"']*)[\"']", m.group(2))
        prefixes[m.group(1)] = p.group(1) if p else ""
    deco = re.compile(r"@(\w+)\.(get|post|put|delete|patch|route|api_route)\s*\(\s*[\"']([^\"']*)[\"']([^)]*)\)\s*(?:\n\s*@[^\n]*)*\n\s*(?:async\s+)?def\s+(\w+)")
    for m in deco.finditer(source):
        verbs = [m.group(2).upper()]
        if m.group(2) in ("route", "api_route"):
            said = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m.group(4))
            verbs = [v.upper() for v in re.findall(r"[\"'](\w+)[\"']", said.group(1))] if said else ["GET"]
        out += [(path, v, join_url(prefixes.get(m.group(1), ""), m.group(3)), m.group(5), m.start()) for v in verbs]
    for m in re.finditer(r"\b(?:re_)?path\s*\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([\w.]+)", source):
        out.append((path, "GET", join_url(re.sub(r"[\^$]", "", m.group(1))), m.group(2), m.start()))
    for m in re.finditer(r"\(\s*r[\"']([^\"']+)[\"']\s*,\s*(\w+Handler)\b", source):
        out.append((path, "GET", join_url(m.group(1)), m.group(2), m.start()))
    return sorted(out, key=lambda r: r[-1])


def python_methods(path: str, source: str) -> list[tuple]:
    """(file, class, function, receiver, called, pos): functions with the class that encloses them, and their calls."""
    lines, out = _blocks(source), []
    for i, (n, indent, text) in enumerate(lines):
        m = re.match(r"\s*(?:async\s+)?def\s+(\w+)", text)
        if not m:
            continue
        owner = next((c.group(1) for _, d, t in reversed(lines[:i]) if d < indent and (c := re.match(r"\s*class\s+(\w+)", t))), None)
        body = []
        for _, deep, t in lines[i + 1 :]:
            if deep <= indent:
                break
            body.append(t)
        calls = re.findall(r"\b(\w+)\.(\w+)\s*\(", "\n".join(body))
        out += [(path, owner, m.group(1), a, b, n * 1000 + k) for k, (a, b) in enumerate(calls)] or [(path, owner, m.group(1), None, None, n * 1000)]
    return out


# Vue, React and stores


def _objects(source: str, clean: str, at: int) -> list[tuple[int, int]]:
    """Bounds of the objects directly inside the array that opens at `at`."""
    end, i, out = closing(clean, at), at + 1, []
    while i < end:
        if clean[i] == "{":
            stop = closing(clean, i)
            out.append((i, stop))
            i = stop
        elif clean[i] in "([":
            i = closing(clean, i)
        i += 1
    return out


def _top(clean: str, a: int, b: int) -> str:
    """The object's text from a to b with everything in inner brackets as spaces."""
    out, i = [], a + 1
    while i < b:
        if clean[i] in PAIRS:
            stop = min(closing(clean, i), b)
            out.append(" " * (stop - i + 1))
            i = stop + 1
        else:
            out.append(clean[i])
            i += 1
    return "".join(out)


def routes(path: str, source: str) -> list[tuple]:
    """(file, id, parent, path, name, component, pos): routes as a tree; operators.tree.flatten joins the paths."""
    clean, out = blank(source), []

    def walk(at: int, parent: str | None) -> None:
        for a, b in _objects(source, clean, at):
            top = _top(clean, a, b)

            def value(key: str) -> str | None:
                m = re.search(rf"(?<![\w$]){key}\s*:", top)
                if not m:
                    return None
                v = re.compile(r"\s*(?:[\"'`]([^\"'`]*)[\"'`]|(?:\(\)\s*=>\s*)?import\s*\(\s*[\"']([^\"']+)[\"']|([\w.]+))").match(source, a + 1 + m.end())
                return next((g for g in v.groups() if g is not None), None) if v else None

            url = value("path")
            own = f"{path}#{a}"
            if url is not None:
                out.append((path, own, parent, url, value("name"), value("component"), a))
            child = re.search(r"\bchildren\s*:\s*\[?", top)
            if child:
                begin = clean.find("[", a + 1 + child.start())
                if 0 <= begin < b:
                    walk(begin, own if url is not None else parent)

    for m in re.finditer(r"(?:\broutes\s*(?::\s*[\w\[\]<>]+)?\s*[:=]\s*|createBrowserRouter\s*\(\s*|:\s*RouteRecordRaw\[\]\s*=\s*)\[", clean):
        walk(m.end() - 1, None)
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"<Route\b((?:[^<>{}]|\{[^{}]*\}|<[^<>]*/>)*?)(/?)>|</Route>", source):
        if m.group(0) == "</Route>":
            if stack:
                stack.pop()
            continue
        p = re.search(r"\bpath\s*=\s*\{?[\"']([^\"']*)[\"']", m.group(1))
        own, parent = f"{path}#{m.start()}", stack[-1][0] if stack else None
        element = re.search(r"<(\w+)", m.group(1))
        out.append((path, own, parent, p.group(1) if p else "", None, element.group(1) if element else None, m.start()))
        if not m.group(2):
            stack.append((own, m.start()))
    seen: dict[str, tuple] = {}
    for r in out:
        seen.setdefault(r[1], r)
    return sorted(seen.values(), key=lambda r: r[-1])


def _keys(clean: str, a: int, b: int) -> list[str]:
    return [k for part in split_top(_top(clean, a, b)) if (m := re.match(r"(?:async\s+|get\s+)?([A-Za-z_$][\w$]*)", part)) for k in [m.group(1)]]


def stores(path: str, source: str) -> list[tuple]:
    """(file, name, store_id, state, getters, actions, pos): Pinia option and setup stores, Vuex stores."""
    clean, out = blank(source), []

    def part(a: int, b: int, key: str) -> list[str]:
        m = re.compile(rf"\b{key}\s*(?::\s*(?:\([^)]*\)\s*(?::\s*\w+\s*)?=>\s*)?\(?|\(\s*\)\s*\{{\s*return\s*)\s*\{{").search(clean, a, b)
        return _keys(clean, m.end() - 1, closing(clean, m.end() - 1)) if m else []

    for m in re.finditer(r"(?:const\s+(\w+)\s*=\s*)?defineStore\s*\(", clean):
        end = closing(clean, m.end() - 1)
        said = re.match(r"\s*[\"']([^\"']+)[\"']", source[m.end() : end])
        body = clean[m.end() : end]
        setup = re.search(r"(?:\(\s*\)\s*=>|function\s*\w*\s*\(\s*\))\s*\{", body)
        options = re.search(r"\{", body)
        if setup and re.match(r"\s*,?\s*$", re.sub(r"[\"'][^\"']*[\"']", "", body[: setup.start()])):
            inner = body[setup.end() :]
            names = lambda p: re.findall(rf"\bconst\s+(\w+)\s*=\s*(?:{p})", inner)  # noqa: E731, B023
            actions = re.findall(r"\bfunction\s+(\w+)", inner) + re.findall(r"\bconst\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", inner)
            out.append((path, m.group(1), said.group(1) if said else None, names(r"ref\s*[<(]|reactive\s*[<(]|shallowRef\s*[<(]"), names(r"computed\s*[<(]"), actions, m.start()))
        elif options:
            a = m.end() + options.start()
            inside = re.search(r"\bid\s*:\s*[\"']([^\"']+)[\"']", source[a:end])
            out.append((path, m.group(1), said.group(1) if said else inside.group(1) if inside else None, part(a, end, "state"), part(a, end, "getters"), part(a, end, "actions"), m.start()))
    for m in re.finditer(r"(?:createStore|new\s+Vuex\.Store)\s*(?:<[^>]*>)?\s*\(\s*\{", clean):
        end = closing(clean, m.end() - 1)
        out.append((path, None, None, part(m.end(), end, "state"), part(m.end(), end, "getters"), part(m.end(), end, "mutations") + part(m.end(), end, "actions"), m.start()))
    return out


def vue_contract(path: str, source: str) -> list[tuple]:
    """(file, props, emits): of script setup's macros or the options."""
    clean = blank(source)

    def names(macro: str, option: str) -> list[str]:
        typed = re.search(rf"\b{macro}\s*<\s*\{{", clean)
        if typed:
            end = closing(clean, typed.end() - 1)
            inner = source[typed.end() : end]
            if macro == "defineEmits":
                calls = re.findall(r"\(\s*\w+\s*:\s*[\"']([\w:-]+)[\"']", inner)
                return calls or re.findall(r"(?m)^\s*[\"']?([\w:-]+)[\"']?\s*[:(]", inner)
            return re.findall(r"(?:^|[;,\n])\s*[\"']?(\w+)[\"']?\??\s*:", inner)
        called = re.search(rf"\b{macro}\s*\(\s*([\[{{])", clean) or re.search(rf"\b{option}\s*:\s*([\[{{])", clean)
        if not called:
            return []
        at = called.start(1)
        end = closing(clean, at)
        if called.group(1) == "[":
            return re.findall(r"[\"']([\w:-]+)[\"']", source[at:end])
        return _keys(clean, at, end)

    return [(path, list(dict.fromkeys(names("defineProps", "props"))), list(dict.fromkeys(names("defineEmits", "emits"))))]


def imports(path: str, source: str) -> list[tuple]:
    """(file, name, target, pos): names a module imports from relative or @/ paths."""
    out = []
    for m in re.finditer(r"import\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s+[\"']([^\"']+)[\"']", source):
        if m.group(2).startswith((".", "@/", "~/")):
            names = re.findall(r"[\w$]+", re.sub(r"\b(?:as|type)\b", " ", m.group(1)))
            out += [(path, n, m.group(2), m.start()) for n in names] or [(path, None, m.group(2), m.start())]
    return out


def resolve(path: str, target: str) -> list[str]:
    """Files that an import may mean, likeliest first."""
    base = re.sub(r"^[@~]/", "src/", target) if target[0] in "@~" else "/".join([*path.split("/")[:-1], target])
    parts: list[str] = []
    for p in base.split("/"):
        if p == "..":
            parts[:] = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    at = "/".join(parts)
    return [at + s for s in ("", ".ts", ".tsx", ".vue", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]


# YAML and CSS


def yml_pairs(path: str, source: str) -> list[tuple]:
    """(file, pos, key, value): scalars by dotted key, parents by indent; lists and anchors are left out."""
    stack: list[tuple[int, str]] = []
    out = []
    for n, line in enumerate(source.split("\n")):
        m = re.match(r"^(\s*)([\w.\-\[\]]+)\s*:\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        indent = len(m.group(1))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        key = ".".join([k for _, k in stack] + [m.group(2)])
        value = re.sub(r"\s+#.*$", "", m.group(3)).strip()
        if value and value[0] not in "|>&*":
            out.append((path, n, key, value.strip("\"'")))
        else:
            stack.append((indent, m.group(2)))
    return out
