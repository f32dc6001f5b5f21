"""Parsers of project manifests: pure functions from a file's text to dependencies, and the DataFrame operator over files.

A parser returns (name, ecosystem, declared version or None, kind) rows in the order that the format asks for: as declared
for JSON objects, text lists and build scripts, by name for the rest. Versions stay strings. A file that does not parse
raises ManifestError; ``read_manifests`` gives such files a row in ``errors`` instead.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple[str, str, str | None, str]


class ManifestError(ValueError):
    """A manifest that can't be parsed."""


def _json(source: str) -> dict:
    try:
        root = json.loads(source)
    except ValueError as e:
        raise ManifestError(f"not JSON: {e}") from e
    if not isinstance(root, dict):
        raise ManifestError("the root is not an object")
    return root


def _toml(source: str) -> dict:
    try:
        return tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        raise ManifestError(f"not TOML: {e}") from e


def _xml(source: str) -> ET.Element:
    try:
        root = ET.fromstring(source.lstrip("﻿ \t\r\n"))
    except ET.ParseError as e:
        raise ManifestError(f"not XML: {e}") from e
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""
    return root


def _text(parent: ET.Element | None, path: str) -> str | None:
    found = parent.find(path) if parent is not None else None
    return (found.text or "").strip() or None if found is not None else None


def _group(root: dict, name: str) -> dict:
    group = root.get(name, {})
    if not isinstance(group, dict):
        raise ManifestError(f"{name} is not an object")
    return group


def package_json(source: str, dev: bool = False, optional: bool = True) -> list[Row]:
    root = _json(source)
    groups = [("dependencies", "runtime", True), ("devDependencies", "dev", dev), ("optionalDependencies", "optional", optional)]
    return [(n, "npm", v if isinstance(v, str) else None, kind) for group, kind, wanted in groups if wanted for n, v in _group(root, group).items()]


#: A requirement: name, extras, a version specifier or an address, and a marker after a semicolon.
_REQUIREMENT = re.compile(r"(?P<name>[A-Za-z0-9][A-Za-z0-9._-]*)\s*(?P<extras>\[[^\]]*\])?\s*(?:(?P<spec>(?:===?|[!<>~]=|[<>])[^;]*?)|@\s*(?P<url>\S+))?\s*(?:;.*)?")


def _requirements(texts: list, kind: str, bare: bool = False) -> list[Row]:
    """The texts that are requirements; ``bare``: without those with extras or an address."""
    found = [_REQUIREMENT.fullmatch(x.strip()) for x in texts if isinstance(x, str)]
    return [(r["name"], "pypi", r["spec"], kind) for r in found if r and not (bare and (r["extras"] or r["url"]))]


def requirements_txt(source: str, dev: bool = False) -> list[Row]:
    return _requirements([re.sub(r"#.*", "", line) for line in source.splitlines()], "runtime", bare=True)


def pyproject_toml(source: str, dev: bool = False) -> list[Row]:
    root = _toml(source)
    project = root.get("project", {})
    declared = project.get("dependencies", []) if isinstance(project, dict) else []
    if declared:
        more = [x for g in project.get("optional-dependencies", {}).values() for x in g] if dev else []
        return _requirements(declared, "runtime") + _requirements(more, "dev")
    poetry = root.get("tool", {}).get("poetry", {})
    groups = [(poetry.get("dependencies", {}), "runtime")]
    if dev:
        groups += [(poetry.get("dev-dependencies", {}), "dev"), *((g.get("dependencies", {}), "dev") for g in poetry.get("group", {}).values())]
    return [(n, "pypi", v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, kind) for group, kind in groups for n, v in group.items() if n.lower() != "python"]


def _blocks(source: str, word: str) -> Iterator[tuple[str, str]]:
    """(statement, comment) of ``word x`` lines and ``word ( ... )`` blocks."""
    inside = False
    for line in source.splitlines():
        body, _, comment = line.partition("//")
        body = body.strip()
        if inside:
            if body.startswith(")"):
                inside = False
            elif body:
                yield body, comment
        elif re.fullmatch(word + r"\s*\(", body):
            inside = True
        elif re.match(word + r"\s+[^(]", body):
            yield body[len(word) :].strip(), comment


def go_mod(source: str, dev: bool = False) -> list[Row]:
    rows = []
    for body, comment in _blocks(source, "require"):
        parts = body.split()
        if "indirect" not in comment and parts:
            rows.append((parts[0], "go", parts[1] if len(parts) > 1 else None, "runtime"))
    return rows


def go_work(source: str) -> list[str]:
    return [body.strip('"') for body, _ in _blocks(source, "use")]


def cargo_toml(source: str, dev: bool = False) -> list[Row]:
    root = _toml(source)
    groups = [("dependencies", "runtime"), *([("dev-dependencies", "dev")] if dev else [])]
    rows = [(n, "cargo", v if isinstance(v, str) else v.get("version") if isinstance(v, dict) and isinstance(v.get("version"), str) else None, kind) for g, kind in groups for n, v in _group(root, g).items()]
    return sorted(rows, key=lambda r: r[0])


def composer_json(source: str, dev: bool = False) -> list[Row]:
    root = _json(source)
    groups = [("require", "runtime"), *([("require-dev", "dev")] if dev else [])]
    rows = [(n, "composer", v if isinstance(v, str) else None, kind) for g, kind in groups for n, v in _group(root, g).items() if not re.match(r"(?:php|hhvm)$|(?:ext|lib)-", n)]
    return sorted(rows, key=lambda r: r[0])


def _properties(root: ET.Element) -> dict[str, str]:
    own = {e.tag: (e.text or "").strip() for e in root.findall("properties/*")}
    for field in ("groupId", "artifactId", "version"):
        parent = _text(root, f"parent/{field}")
        if parent:
            own[f"parent.{field}"] = own[f"project.parent.{field}"] = parent
        value = _text(root, field) or (parent if field != "artifactId" else None)
        if value:
            own[f"project.{field}"] = value
    return own


def _resolved(value: str | None, properties: dict[str, str], hops: int = 2) -> str | None:
    """The value with ${...} filled in at most two times; None if any is left."""
    for _ in range(hops):
        if value is None or "${" not in value:
            break
        value = re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), value)
    return None if value is not None and "${" in value else value


def pom_xml(source: str, dev: bool = False) -> list[Row]:
    root = _xml(source)
    properties = _properties(root)
    managed = {}
    for d in root.findall("dependencyManagement/dependencies/dependency"):
        version = _resolved(_text(d, "version"), properties)
        if version:
            managed[f"{_resolved(_text(d, 'groupId'), properties)}:{_text(d, 'artifactId')}"] = version
    rows = []
    for d in root.findall("dependencies/dependency"):
        group, artifact, scope = _resolved(_text(d, "groupId"), properties), _text(d, "artifactId"), _text(d, "scope")
        if not group or not artifact or scope == "system" or (scope == "test" and not dev):
            continue
        name = f"{group}:{artifact}"
        rows.append((name, "maven", _resolved(_text(d, "version"), properties) or managed.get(name), "dev" if scope == "test" else "runtime"))
    return sorted(rows, key=lambda r: r[0])


def pom_parts(source: str) -> dict:
    """A POM's own coordinates, parent, imported bills, managed versions in order, and modules of an aggregator."""
    root = _xml(source)
    properties = _properties(root)
    imports, managed = [], []
    for d in root.findall("dependencyManagement/dependencies/dependency"):
        group, artifact, version = (_resolved(_text(d, f), properties) for f in ("groupId", "artifactId", "version"))
        if not (group and artifact and version):
            continue
        if _text(d, "scope") == "import":
            imports.append(f"{group}:{artifact}:{version}")
        else:
            managed.append((f"{group}:{artifact}", version))
    parent = [_text(root, f"parent/{f}") for f in ("groupId", "artifactId", "version")]
    modules = [(m.text or "").strip() for m in root.findall("modules/module")] if _text(root, "packaging") == "pom" else []
    return {"gav": ":".join(properties.get(f"project.{f}", "") for f in ("groupId", "artifactId", "version")), "parent": ":".join(parent) if all(parent) else None, "imports": imports, "managed": managed, "modules": [m for m in modules if m]}


# Maven coordinates of Gradle plugins.
GRADLE_PLUGINS = {
    "org.jetbrains.kotlin.jvm": "org.jetbrains.kotlin:kotlin-gradle-plugin",
    "org.jetbrains.kotlin.android": "org.jetbrains.kotlin:kotlin-gradle-plugin",
    "org.jetbrains.kotlin.multiplatform": "org.jetbrains.kotlin:kotlin-gradle-plugin",
    "org.jetbrains.kotlin.kapt": "org.jetbrains.kotlin:kotlin-gradle-plugin",
    "org.jetbrains.kotlin.plugin.serialization": "org.jetbrains.kotlin:kotlin-serialization",
    "org.jetbrains.kotlin.plugin.spring": "org.jetbrains.kotlin:kotlin-allopen",
    "org.jetbrains.kotlin.plugin.jpa": "org.jetbrains.kotlin:kotlin-noarg",
    "org.jetbrains.kotlin.plugin.allopen": "org.jetbrains.kotlin:kotlin-allopen",
    "org.jetbrains.kotlin.plugin.noarg": "org.jetbrains.kotlin:kotlin-noarg",
    "org.springframework.boot": "org.springframework.boot:spring-boot-gradle-plugin",
    "io.spring.dependency-management": "io.spring.gradle:dependency-management-plugin",
    "com.android.application": "com.android.tools.build:gradle",
    "com.android.library": "com.android.tools.build:gradle",
    "com.android.test": "com.android.tools.build:gradle",
    "com.android.dynamic-feature": "com.android.tools.build:gradle",
    "com.diffplug.spotless": "com.diffplug.spotless:spotless-plugin-gradle",
    "org.sonarqube": "org.sonarsource.scanner.gradle:sonarqube-gradle-plugin",
    "checkstyle": "com.puppycrawl.tools:checkstyle",
    "pmd": "net.sourceforge.pmd:pmd",
    "jacoco": "org.jacoco:org.jacoco.core",
    "com.github.ben-manes.versions": "com.github.ben-manes:gradle-versions-plugin",
    "org.flywaydb.flyway": "org.flywaydb:flyway-gradle-plugin",
    "org.jetbrains.dokka": "org.jetbrains.dokka:dokka-gradle-plugin",
    "maven-publish": "org.gradle:maven-publish",
    "com.gradle.plugin-publish": "com.gradle.publish:plugin-publish-plugin",
    "io.github.gradle-nexus.publish-plugin": "io.github.gradle-nexus:publish-plugin",
    "com.github.johnrengelman.shadow": "com.github.johnrengelman.shadow:gradle-plugin",
    "io.github.goooler.shadow": "io.github.goooler.shadow:gradle-plugin",
    "com.gorylenko.gradle-git-properties": "com.gorylenko.gradle-git-properties:gradle-git-properties",
    "org.openapi.generator": "org.openapitools:openapi-generator-gradle-plugin",
    "com.google.protobuf": "com.google.protobuf:protobuf-gradle-plugin",
    "idea": "org.gradle:idea",
    "eclipse": "org.gradle:eclipse",
}


def versions_toml(source: str, dev: bool = False) -> list[Row]:
    root = _toml(source)
    versions = {k: v for k, v in _group(root, "versions").items() if isinstance(v, str)}

    def version_of(entry: dict) -> str | None:
        v = entry.get("version")
        return v if isinstance(v, str) else versions.get(v.get("ref")) if isinstance(v, dict) else None

    rows = []
    for entry in _group(root, "libraries").values():
        if isinstance(entry, str):
            parts = entry.split(":")
            if len(parts) >= 2:
                rows.append((":".join(parts[:2]), "maven", parts[2] if len(parts) > 2 else None, "runtime"))
        elif isinstance(entry, dict):
            name = entry.get("module") or (f"{entry['group']}:{entry['name']}" if entry.get("group") and entry.get("name") else None)
            if name:
                rows.append((name, "maven", version_of(entry), "runtime"))
    for entry in _group(root, "plugins").values():
        plugin, version = (entry.partition(":")[::2] if isinstance(entry, str) else (entry.get("id"), version_of(entry)) if isinstance(entry, dict) else ("", None))
        if plugin in GRADLE_PLUGINS:
            rows.append((GRADLE_PLUGINS[plugin], "maven", version or None, "runtime"))
    return sorted(rows, key=lambda r: r[0])


RUNTIME = ("implementation", "api", "compileOnly", "runtimeOnly", "compileClasspath", "runtimeClasspath")
DEV = ("testImplementation", "testCompileOnly", "testRuntimeOnly", "androidTestImplementation")


def _uncommented(source: str) -> str:
    return re.sub(r"(?<!:)//[^\n]*", "", re.sub(r"/\*.*?\*/", "", source, flags=re.S))


def build_gradle(source: str, dev: bool = False) -> list[Row]:
    source, rows = _uncommented(source), []
    words = [*RUNTIME, *(DEV if dev else ())]
    head = r"(?<![\w.])(" + "|".join(words) + r")\b\s*\(?\s*"
    shapes = [
        re.compile(head + r"""["']([^"':\s]+):([^"':\s]+)(?::([^"']+))?["']"""),
        re.compile(head + r"""group\s*:\s*["']([^"']+)["']\s*,\s*name\s*:\s*["']([^"']+)["'](?:\s*,\s*version\s*:\s*["']([^"']+)["'])?"""),
        re.compile(head + r"""group\s*=\s*["']([^"']+)["']\s*,\s*name\s*=\s*["']([^"']+)["'](?:\s*,\s*version\s*=\s*["']([^"']+)["'])?"""),
    ]
    found = sorted((m for shape in shapes for m in shape.finditer(source)), key=lambda m: m.start())
    for m in found:
        # A version that is yet to be filled in names no dependency.
        if "$" not in (m[4] or ""):
            rows.append((f"{m[2]}:{m[3]}", "maven", m[4], "dev" if m[1] in DEV else "runtime"))
    for body in re.findall(r"plugins\s*\{(.*?)\}", source, re.S):
        for m in re.finditer(r"""\bid\s*\(?\s*["']([^"']+)["']\s*\)?(?:\s*version\s*\(?\s*["']([^"']+)["'])?""", body):
            if m[1] in GRADLE_PLUGINS:
                rows.append((GRADLE_PLUGINS[m[1]], "maven", None if m[2] is None or "$" in m[2] else m[2], "runtime"))
    first: dict[tuple, Row] = {}
    for row in rows:
        first.setdefault((row[0], row[1], row[3]), row)
    return list(first.values())


def settings_gradle(source: str) -> list[str]:
    source = _uncommented(source)
    lists = re.findall(r"\binclude\s*\(([^)]*)\)", source) + re.findall(r"""\binclude\s+((?:["'][^"']+["']\s*,?\s*)+)""", source)
    names = [x.removeprefix(":").replace(":", "/") for body in lists for x in re.findall(r"""["']([^"']+)["']""", body)]
    return list(dict.fromkeys(names))


def gemfile_lock(source: str, dev: bool = False) -> list[Row]:
    rows, inside = [], False
    for line in source.splitlines():
        if line and not line[0].isspace():
            inside = line.strip() == "DEPENDENCIES"
        elif inside and (m := re.match(r"^ {2}([A-Za-z0-9_.-]+)!?(?:\s*\(([^)]+)\))?!?\s*$", line)):
            rows.append((m[1], "gem", m[2], "runtime"))
    return sorted(rows, key=lambda r: r[0])


def gemfile(source: str, dev: bool = False) -> list[Row]:
    rows, stack = [], ["runtime"]
    for line in source.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).strip()
        if m := re.match(r"group\b(.*)\bdo\b", line):
            names = re.findall(r":(\w+)", m[1])
            stack.append("dev" if names and all(n in ("development", "test", "dev") for n in names) else stack[-1])
        elif re.search(r"\bdo\b\s*(\|[^|]*\|)?$", line) or re.match(r"(if|unless|case)\b", line):
            stack.append(stack[-1])
        elif line == "end" and len(stack) > 1:
            stack.pop()
        elif m := re.match(r"""gem\s*\(?\s*["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", line):
            if stack[-1] == "runtime" or dev:
                rows.append((m[1], "gem", m[2], stack[-1]))
    return sorted(rows, key=lambda r: r[0])


def _attribute(e: ET.Element, name: str) -> str | None:
    return (e.get(name) or _text(e, name) or "").strip() or None


def csproj(source: str, dev: bool = False) -> list[Row]:
    rows, seen = [], set()
    for e in _xml(source).iter("PackageReference"):
        name = _attribute(e, "Include")
        if not name or name in seen:
            continue
        # A name counts as seen even if its kind is not wanted.
        seen.add(name)
        kind = "dev" if (_attribute(e, "PrivateAssets") or "").lower() == "all" else "runtime"
        if kind == "runtime" or dev:
            rows.append((name, "nuget", _attribute(e, "Version"), kind))
    return sorted(rows, key=lambda r: r[0])


def directory_packages_props(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for e in _xml(source).iter("PackageVersion"):
        name, version = _attribute(e, "Include"), _attribute(e, "Version")
        if name and version:
            found.setdefault(name, version)
    return found


def sln(source: str) -> list[str]:
    names = re.findall(r'^Project\([^)]*\)\s*=\s*"[^"]*"\s*,\s*"([^"]+\.csproj)"', source, re.M | re.I)
    return list(dict.fromkeys(n.replace("\\", "/") for n in names))


def pnpm_workspace(source: str) -> list[str]:
    """The package globs of a workspace file: a list of plain or quoted strings."""
    body = re.search(r"^packages:\s*\n((?:\s+-.*\n?|\s*#.*\n?|\s*\n)+)", source, re.M)
    return [m.strip().strip("'\"") for m in re.findall(r"^\s+-\s*(.+?)\s*(?:#.*)?$", body[1], re.M)] if body else []


#: By file name; the first that fits parses.
PARSERS: list[tuple[str, Callable[..., list[Row]]]] = [
    (r"package\.json$", package_json), (r"requirements[\w.-]*\.txt$", requirements_txt), (r"pyproject\.toml$", pyproject_toml), (r"go\.mod$", go_mod),
    (r"Cargo\.toml$", cargo_toml), (r"composer\.json$", composer_json), (r"pom[\w.-]*\.xml$", pom_xml), (r"\.versions\.toml$", versions_toml),
    (r"build\.gradle(\.kts)?$", build_gradle), (r"Gemfile\.lock$", gemfile_lock), (r"Gemfile$", gemfile), (r"\.csproj$", csproj),
]
# Which manifest of a folder is its own, first to last; names that begin with a dot are endings. The first ten are documented, the others
# come after them.
PRIORITY = ["pom.xml", ".sln", ".csproj", "Cargo.toml", "composer.json", "go.work", "go.mod", "pyproject.toml", "package.json", "Gemfile.lock"]
PRIORITY += ["libs.versions.toml", "build.gradle.kts", "build.gradle", "requirements.txt", "Gemfile"]


def parser_of(path: str) -> Callable[..., list[Row]] | None:
    name = path.rpartition("/")[2]
    return next((parse for pattern, parse in PARSERS if re.search(pattern if pattern.startswith(r"\.") else "^" + pattern, name)), None)


def read_manifests(files: DataFrame, dev: bool = False, optional: bool = True) -> DataFrame:
    """files (path, content) to manifest_path, pos, name, ecosystem, declared_version, kind, error: a row a dependency,
    or one with the error for a file that does not parse. Files of other names give no rows."""
    schema = "manifest_path string, pos int, name string, ecosystem string, declared_version string, kind string, error string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                parse = parser_of(path or "")
                if parse is None or content is None:
                    continue
                try:
                    found = parse(content, dev, optional) if parse is package_json else parse(content, dev)
                    rows += [(path, i, *row, None) for i, row in enumerate(found)]
                except ManifestError as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=columns)
            out["pos"] = out["pos"].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, schema)


def placed_manifests(files: DataFrame) -> DataFrame:
    """files (path, ...) that are manifests by name, with folder (whose manifest it is: a version catalogue in ``gradle`` is that of the folder above), turn
    (by priority) and type."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    fits = [(name == p if not p.startswith(".") else F.endswith(name, F.lit(p)), p) for p in PRIORITY]
    turn = F.coalesce(*[F.when(fit, F.lit(i)) for i, (fit, _) in enumerate(fits)])
    kind = F.coalesce(*[F.when(fit, F.lit(p.removeprefix("."))) for fit, p in fits])
    folder = F.regexp_replace(F.regexp_replace("path", r"(^|/)gradle/libs\.versions\.toml$", "$1libs.versions.toml"), "/?[^/]*$", "")
    return files.withColumns({"folder": folder, "turn": turn, "type": kind}).where("turn is not null")


def primary_manifest(files: DataFrame) -> DataFrame:
    """files (path, content) to one a folder, the first by priority, then by name."""
    from quarrylight.operators.dependencies import first_wins

    return first_wins(placed_manifests(files), ["folder"], ["turn", "path"]).drop("turn", "type")
