import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dependencies as dep
from quarrylight.sources import manifests as m


def test_package_json():
    source = '{"dependencies": {"z": "^1", "a": "2"}, "devDependencies": {"d": "3"}, "optionalDependencies": {"o": "4"}}'
    assert m.package_json(source) == [("z", "npm", "^1", "runtime"), ("a", "npm", "2", "runtime"), ("o", "npm", "4", "optional")]
    assert [r[0] for r in m.package_json(source, dev=True, optional=False)] == ["z", "a", "d"]
    for bad in ("[]", "{", '{"dependencies": []}'):
        with pytest.raises(m.ManifestError):
            m.package_json(bad)


def test_python_files():
    text = "# c\n-e .\n-r other.txt\n--index-url x\nflask>=2,<3 ; python_version > '3'\nrequests==2.0 # pinned\npkg[extra]==1\nplain\n"
    assert m.requirements_txt(text) == [("flask", "pypi", ">=2,<3", "runtime"), ("requests", "pypi", "==2.0", "runtime"), ("plain", "pypi", None, "runtime")]
    pep = '[project]\ndependencies = ["a[x]>=1; python_version>\'3\'", "b @ https://x", "c"]\n[project.optional-dependencies]\nt = ["d"]\n'
    assert m.pyproject_toml(pep) == [("a", "pypi", ">=1", "runtime"), ("b", "pypi", None, "runtime"), ("c", "pypi", None, "runtime")]
    assert m.pyproject_toml(pep, dev=True)[-1] == ("d", "pypi", None, "dev")
    poetry = '[tool.poetry.dependencies]\npython = "^3"\nx = "1"\ny = {version = "2", extras = ["a"]}\n[tool.poetry.group.dev.dependencies]\nz = "3"\n'
    assert m.pyproject_toml(poetry, dev=True) == [("x", "pypi", "1", "runtime"), ("y", "pypi", "2", "runtime"), ("z", "pypi", "3", "dev")]


def test_go_files():
    text = "module x\nrequire github.com/a/b v1.0.0\nrequire (\n\tgithub.com/c/d v2 // indirect\n\tgithub.com/e/f/v3 v3.1 // note\n)\n"
    assert m.go_mod(text) == [("github.com/a/b", "go", "v1.0.0", "runtime"), ("github.com/e/f/v3", "go", "v3.1", "runtime")]
    assert m.go_work("go 1.2\nuse ./a\nuse (\n ./b // c\n ./c\n)\n") == ["./a", "./b", "./c"]


def test_cargo_and_composer():
    assert m.cargo_toml('[dependencies]\nz = "1"\na = {version = "2"}\np = {path = "x"}\n[dev-dependencies]\nd = "3"\n') == [("a", "cargo", "2", "runtime"), ("p", "cargo", None, "runtime"), ("z", "cargo", "1", "runtime")]
    assert m.composer_json('{"require": {"php": "8", "ext-x": "*", "b/c": "1", "a/b": "2"}, "require-dev": {"x/y": "3"}}') == [("a/b", "composer", "2", "runtime"), ("b/c", "composer", "1", "runtime")]


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g.p</groupId><artifactId>par</artifactId><version>9</version></parent>
<artifactId>app</artifactId><packaging>pom</packaging><modules><module>one</module></modules>
<properties><v>1.10</v><w>${v}</w><deep>${w}</deep><loop>${loop}</loop></properties>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId><version>${w}</version></dependency>
<dependency><groupId>b</groupId><artifactId>bom</artifactId><version>2</version><scope>import</scope><type>pom</type></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId></dependency><dependency><groupId>${project.groupId}</groupId><artifactId>own</artifactId><version>${project.version}</version></dependency>
<dependency><groupId>a</groupId><artifactId>loop</artifactId><version>${loop}</version></dependency><dependency><groupId>s</groupId><artifactId>sys</artifactId><scope>system</scope></dependency>
<dependency><groupId>t</groupId><artifactId>test</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>"""


def test_pom():
    assert m.pom_xml(POM) == [("a:loop", "maven", None, "runtime"), ("g.p:own", "maven", "9", "runtime"), ("m:managed", "maven", "1.10", "runtime")]
    assert ("t:test", "maven", "1", "dev") in m.pom_xml(POM, dev=True)
    parts = m.pom_parts(POM)
    assert (parts["gav"], parts["parent"], parts["imports"], parts["managed"], parts["modules"]) == ("g.p:app:9", "g.p:par:9", ["b:bom:2"], [("m:managed", "1.10")], ["one"])
    with pytest.raises(m.ManifestError):
        m.pom_xml("<project>")


def test_gradle():
    catalog = '[versions]\nk = "1.9"\n[libraries]\na = "g:a:1"\nb = {module = "g:b", version.ref = "k"}\nc = {group = "g", name = "c", version = "3"}\nd = {module = "g:d", version.ref = "none"}\n[plugins]\np = {id = "org.springframework.boot", version.ref = "k"}\nq = {id = "unknown", version = "1"}\n'
    assert m.versions_toml(catalog) == [("g:a", "maven", "1", "runtime"), ("g:b", "maven", "1.9", "runtime"), ("g:c", "maven", "3", "runtime"), ("g:d", "maven", None, "runtime"), ("org.springframework.boot:spring-boot-gradle-plugin", "maven", "1.9", "runtime")]
    build = """plugins { id 'org.springframework.boot' version '3.1'\n id("java") }
    dependencies { implementation 'g:a:1.0' // note 'g:no:1'
      api("g:b:$v")
      implementation group: 'g', name: 'c', version: '2'
      runtimeOnly(group = "g", name = "d", version = "3")
      testImplementation 'g:t:1'
      implementation 'g:a:2.0' /* implementation 'g:x:1' */ }"""
    build = build.replace("testImpl", "api platform('g:p:1')\n kapt 'g:k:1'\n testImpl")
    assert m.build_gradle(build) == [("g:a", "maven", "1.0", "runtime"), ("g:c", "maven", "2", "runtime"), ("g:d", "maven", "3", "runtime"), ("org.springframework.boot:spring-boot-gradle-plugin", "maven", "3.1", "runtime")]
    assert ("g:t", "maven", "1", "dev") in m.build_gradle(build, dev=True)
    assert m.settings_gradle("include(\":app\", \":lib:core\")\ninclude ':app', ':x'") == ["app", "lib/core", "x"]


def test_ruby_and_dotnet():
    assert m.gemfile_lock("GEM\n  specs:\n    a (1)\n\nDEPENDENCIES\n  rails (~> 7)\n  pg\n  own!\n    deep\nPLATFORMS\n  ruby\n") == [("own", "gem", None, "runtime"), ("pg", "gem", None, "runtime"), ("rails", "gem", "~> 7", "runtime")]
    text = "gem 'rails', '~> 7'\ngroup :development, :test do\n  gem 'rspec'\n  platforms :ruby do\n    gem 'x'\n  end\nend\ngem \"pg\"\n"
    assert m.gemfile(text) == [("pg", "gem", None, "runtime"), ("rails", "gem", "~> 7", "runtime")]
    assert [r[0] for r in m.gemfile(text, dev=True)] == ["pg", "rails", "rspec", "x"]
    project = '<Project><ItemGroup><PackageReference Include="B" Version="1"/><PackageReference Include="A"><Version>2</Version></PackageReference><PackageReference Include="T" Version="1" PrivateAssets="all"/><PackageReference Include="T" Version="2"/></ItemGroup></Project>'
    assert m.csproj(project) == [("A", "nuget", "2", "runtime"), ("B", "nuget", "1", "runtime")]
    assert m.directory_packages_props('<Project><ItemGroup><PackageVersion Include="B" Version="1"/><PackageVersion Include="B" Version="2"/></ItemGroup></Project>') == {"B": "1"}
    assert m.sln('Project("{F}") = "A", "src\\A\\A.csproj", "{G}"\nEndProject\nProject("{F}") = "S", "S", "{H}"\n') == ["src/A/A.csproj"]
    assert m.pnpm_workspace("packages:\n  - 'packages/*'\n  - \"!packages/x\"\n  - apps/one # c\n") == ["packages/*", "!packages/x", "apps/one"]


def test_files_to_dependencies(spark):
    files = spark.createDataFrame([("a/package.json", '{"dependencies": {"react": "18"}}'), ("a/requirements.txt", "flask"), ("b/pom.xml", "<oops"), ("c/readme.md", "x"), ("d/App.csproj", "<Project/>")], "path string, content string")
    rows = {(r["manifest_path"], r["name"], r["error"] is not None) for r in m.read_manifests(files).collect()}
    assert rows == {("a/package.json", "react", False), ("a/requirements.txt", "flask", False), ("b/pom.xml", None, True)}
    assert sorted(r["path"] for r in m.primary_manifest(files).collect()) == ["a/package.json", "b/pom.xml", "d/App.csproj"]


def test_bills_of_materials(spark):
    """Nearer wins, then the later sibling; a cycle ends; nothing below the fifth level."""
    imports = spark.createDataFrame([("p", "b1", 0), ("p", "b2", 1)], "project string, gav string, pos int")
    edges = spark.createDataFrame([("b1", "c", 0), ("c", "b1", 0), ("c", "d3", 1), ("d3", "d4", 0), ("d4", "d5", 0)], "gav string, child string, pos int")
    managed = [("b1", "x", "1", 0), ("b2", "x", "2", 0), ("c", "x", "3", 0), ("c", "y", "4", 0), ("c", "y", "5", 1), ("d4", "z", "6", 0), ("d5", "w", "7", 0)]
    found = dep.bom_versions(imports, spark.createDataFrame(managed, "gav string, coord string, version string, pos int"), edges)
    assert {r["coord"]: r["version"] for r in found.collect()} == {"x": "2", "y": "5", "z": "6", "w": "7"}
    assert "w" not in {r["coord"] for r in dep.bom_versions(imports, spark.createDataFrame(managed, "gav string, coord string, version string, pos int"), edges, depth=4).collect()}
    deps = spark.createDataFrame([("p", "x", "maven", None), ("p", "y", "maven", "own"), ("p", "x", "npm", None)], "project string, name string, ecosystem string, declared_version string")
    assert sorted(((r["name"], r["ecosystem"], r["declared_version"]) for r in dep.fill_versions(deps, found).collect()), key=str) == [("x", "maven", "2"), ("x", "npm", None), ("y", "maven", "own")]
    parents = spark.createDataFrame([("p", "par")], "project string, gav string")
    more = spark.createDataFrame([("par", "b9", 0)], "gav string, child string, pos int")
    assert [(r["gav"], r["pos"]) for r in dep.with_parents(imports, parents, more).orderBy("pos").collect()] == [("b1", 0), ("b2", 1), ("b9", 2)]


def test_registries(spark):
    rows = [
        ("a", "npm", 200, '{"repository": {"url": "git+https://github.com/o/a.git"}}', ("o", "a", "npm-registry", "high", [])),
        ("s", "npm", 200, '{"repository": "o/s"}', ("o", "s", "npm-registry", "high", [])),
        ("gone", "npm", 404, None, (None, None, None, None, [])),
        ("down", "npm", 503, None, ("down", "down", "fuzzy", "low", [])),
        ("nowhere", "npm", 200, "{}", (None, None, None, None, [])),
        ("p", "pypi", 200, '{"info": {"home_page": "https://github.com/o/home", "project_urls": {"Source": "https://github.com/o/p"}}}', ("o", "p", "pypi", "high", ["o/home"])),
        ("c", "cargo", 200, '{"crate": {"homepage": "https://github.com/o/c"}}', ("o", "c", "crates-io", "medium", [])),
        ("e", "cargo", 200, "{}", ("e", "e", "fuzzy", "low", [])),
        ("v/k", "composer", 500, None, ("v", "k", "fuzzy", "low", [])),
        ("noslash", "composer", 500, None, (None, None, None, None, [])),
        ("g:a", "maven", 200, '{"scm": {"connection": "scm:git:https://github.com/o/m.git"}}', ("o", "m", "maven-central", "high", [])),
        ("g:b", "maven", 500, None, (None, None, None, None, [])),
        ("github.com/o/g/v2", "go", 200, None, ("o", "g", "go-proxy", "high", [])),
        ("github.com/o/h", "go", 500, None, (None, None, None, None, [])),
        ("r", "gem", 200, '{"homepage_uri": "https://github.com/o/r"}', ("o", "r", "rubygems", "medium", [])),
        ("N.X", "nuget", 200, '{"projectUrl": "https://github.com/o/n", "repository": {"url": "https://github.com/o/n2"}}', ("o", "n2", "nuget", "high", ["o/n"])),
    ]
    packages = spark.createDataFrame([r[:2] for r in rows], "name string, ecosystem string")
    registry = spark.createDataFrame([r[:4] for r in rows], "name string, ecosystem string, http_status int, json string")
    got = {r["name"]: (r["owner"], r["repo"], r["source"], r["confidence"], r["alternates"]) for r in dep.resolve_repos(packages, registry).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_frameworks_members_and_roots(spark):
    deps = spark.createDataFrame([("p", "react", "npm", 1), ("p", "next", "npm", 0), ("p", "org.springframework.boot:spring-boot-starter-web", "maven", 2), ("p", "org.springframework.boot:spring-boot-starter-x", "maven", 3), ("p", "react", "pypi", 4)], "project string, name string, ecosystem string, pos int")
    assert {(r["framework"], r["pos"]) for r in dep.detect_frameworks(deps).collect()} == {("React", 1), ("next.js", 0), ("Spring Boot", 2)}
    files = spark.createDataFrame([("a/package.json",), ("a/sub/package.json",), ("b/c/go.mod",), ("node_modules/x/package.json",), ("a2/pom.xml",)], "path string")
    assert sorted(r["folder"] for r in dep.project_roots(files).collect()) == ["a", "a2", "b/c"]


def test_kinds_and_watch_set(spark):
    roots = spark.createDataFrame([("x", 2, 0, 0), ("x", 0, 1, 0), ("y", 1, 0, 0), ("z", 0, 0, 0)], "path string, class int, root_idx int, pos int")
    assert [r["path"] for r in dep.watch_set(roots, 2).collect()] == ["z", "x"]
    kinds = spark.createDataFrame([("a", "runtime"), ("b", "dev"), ("c", "optional"), ("d", None)], "name string, kind string")
    assert [r["name"] for r in dep.wanted_kinds(kinds).orderBy("name").collect()] == ["a", "c", "d"]


def test_probe_and_difference(spark):
    deps = spark.createDataFrame([("a", "npm", "dev"), ("b", "npm", "runtime")], "name string, ecosystem string, kind string")
    repos = spark.createDataFrame([("a", "npm", "o", "a", "s", "high")], "query string, ecosystem string, owner string, repo string, source string, confidence string")
    wiki = spark.createDataFrame([("o/a", True, 3)], "repo string, has_wiki boolean, page_count int")
    assert sorted((r["name"], r["has_wiki"]) for r in dep.resolve_and_probe(deps, repos, wiki).collect()) == [("a", True), ("b", None)]
    after = deps.where("name = 'a'").withColumn("kind", F.lit("runtime"))
    assert [r["name"] for r in dep.removed(deps, after).collect()] == ["b"]


def test_a_bill_gives_one_entry_a_coordinate(spark):
    """What is joined to the projects does not grow with a bill's repeated entries; the later entry wins, of equal ones the greater version."""
    imports = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "b", 0)], "project string, gav string, pos int")
    managed = spark.createDataFrame([("b", "x:y", f"{i}.0", i) for i in range(500)] + [("b", "x:y", "9.9", 499), ("b", "x:y", "0.1", None), ("a", "x:z", "7.0", None)], "gav string, coord string, version string, pos int")
    edges = spark.createDataFrame([], "gav string, child string, pos int")
    found = dep.bom_versions(imports, managed, edges)
    assert sorted(map(tuple, found.collect())) == [("p", "x:y", "9.9", 0), ("p", "x:z", "7.0", 0), ("q", "x:y", "9.9", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" in plan[plan.index("Join"):]


def test_the_whole_closure_of_bills(spark):
    """Without a depth, a long chain with a cycle is followed to its end; the default keeps to its levels."""
    imports = spark.createDataFrame([("p", "b0", 0), ("q", "b9", 0)], "project string, gav string, pos int")
    edges = spark.createDataFrame([(f"b{i}", f"b{i + 1}", 0) for i in range(11)] + [("b11", "b2", 0), ("b1", "b5", 1)], "gav string, child string, pos int")
    managed = spark.createDataFrame([(f"b{i}", c, f"{i}", 0) for i in range(12) for c in (f"own{i}", f"mod{i % 3}")], "gav string, coord string, version string, pos int")
    depths = {"p": {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, **{i: i - 3 for i in range(5, 12)}}, "q": {i: (i - 9 if i > 8 else i + 1) for i in range(2, 12)}}
    found = {(r["project"], r["coord"]): (r["version"], r["depth"]) for r in dep.bom_versions(imports, managed, edges, depth=None).collect()}
    assert {k: v for k, v in found.items() if k[1].startswith("own")} == {(p, f"own{i}"): (str(i), d) for p, own in depths.items() for i, d in own.items()}
    assert {k: v[1] for k, v in found.items() if k[1].startswith("mod")} == {(p, f"mod{m}"): min(d for i, d in own.items() if i % 3 == m) for p, own in depths.items() for m in range(3)}
    assert max(r["depth"] for r in dep.bom_versions(imports, managed, edges).collect()) == 4
