from quarrylight.sources import workspaces as w


def test_members(spark):
    files = [
        ("package.json", '{"workspaces": ["packages/*", "!packages/skip", "/abs", "a/**"]}'), ("packages/a/package.json", "{}"), ("packages/skip/package.json", "{}"), ("packages/a/deep/package.json", "{}"),
        ("rs/Cargo.toml", '[workspace]\nmembers = ["x", "gone"]\n'), ("rs/x/Cargo.toml", ""), ("go.work", "use (\n ./svc\n)\n"), ("svc/go.mod", ""),
        ("App.sln", 'Project("{F}") = "A", "src\\A\\A.csproj", "{G}"'), ("src/A/A.csproj", ""), ("jv/settings.gradle", "include ':lib:core'"), ("jv/lib/core/build.gradle.kts", ""),
        ("mv/pom.xml", "<project><packaging>pom</packaging><modules><module>m1</module><module>m2</module></modules></project>"), ("mv/m1/pom.xml", "<project/>"), ("bad/package.json", "{"),
    ]
    got = sorted((r["root"], r["member"]) for r in w.workspace_members(spark.createDataFrame(files, "path string, content string")).collect())
    assert got == [("App.sln", "src/A/A.csproj"), ("go.work", "svc/go.mod"), ("jv/settings.gradle", "jv/lib/core/build.gradle.kts"), ("mv/pom.xml", "mv/m1/pom.xml"), ("package.json", "packages/a/package.json"), ("rs/Cargo.toml", "rs/x/Cargo.toml")]


def test_central_versions(spark):
    props = [("Directory.Packages.props", '<Project><PackageVersion Include="A" Version="1"/><PackageVersion Include="B" Version="2"/></Project>'), ("src/Directory.Packages.props", '<Project><PackageVersion Include="A" Version="9"/></Project>'), ("x/Directory.Packages.props", "<oops")]
    refs = spark.createDataFrame([("src/app/a.csproj", "A", None), ("src/app/a.csproj", "B", None), ("a.csproj", "A", None), ("a.csproj", "B", "own"), ("a.csproj", "C", None)], "manifest_path string, name string, declared_version string")
    got = {(r["manifest_path"], r["name"]): r["declared_version"] for r in w.central_versions(refs, spark.createDataFrame(props, "path string, content string")).collect()}
    assert got == {("src/app/a.csproj", "A"): "9", ("src/app/a.csproj", "B"): "2", ("a.csproj", "A"): "1", ("a.csproj", "B"): "own", ("a.csproj", "C"): None}


def test_poms_and_upward(spark, tmp_path):
    pom = "<project><groupId>g</groupId><artifactId>a</artifactId><version>1</version><dependencyManagement><dependencies><dependency><groupId>b</groupId><artifactId>m</artifactId><version>2</version><scope>import</scope></dependency><dependency><groupId>c</groupId><artifactId>d</artifactId><version>3</version></dependency></dependencies></dependencyManagement></project>"
    parents, imports, managed = w.read_poms(spark.createDataFrame([("pom.xml", pom), ("x/pom.xml", "<")], "path string, content string"))
    assert [tuple(r) for r in parents.collect()] == [("pom.xml", "g:a:1", None)]
    assert [(r["gav"], r["child"]) for r in imports.collect()] == [("g:a:1", "b:m:2")] and [(r["coord"], r["version"]) for r in managed.collect()] == [("c:d", "3")]
    (tmp_path / "p/q/r").mkdir(parents=True)
    (tmp_path / "p/go.mod").write_text("module x")
    (tmp_path / "p/package.json").write_text("{}")
    assert w.upward_manifest(str(tmp_path / "p/q/r"), str(tmp_path)) == str(tmp_path / "p/go.mod")
    assert w.upward_manifest(str(tmp_path / "p/q/r"), str(tmp_path / "p/q")) is None
    assert w.upward_manifest(str(tmp_path / "p/q/r"), str(tmp_path), levels=1) is None


def scanned(spark, files):
    rows = w.scans(spark.createDataFrame(files, "path string, content string")).orderBy("manifest_idx", "file_pos").collect()
    out = {}
    for r in rows:
        out.setdefault((r["project_root"], r["manifest_type"]), []).append(r["path"])
    return list(out.items())


POM = "<project><packaging>pom</packaging><modules>{}</modules></project>"


def test_scans_of_a_tree(spark):
    """Priority in a folder, folders below a root and ignored ones, members, solutions with and without projects, catalogues."""
    files = [
        ("app/pom.xml", "<project/>"), ("app/package.json", '{"dependencies":{"docs-tool":"1"}}'), ("app/sub/package.json", "{}"), ("node_modules/x/package.json", "{}"), (".git/package.json", "{}"), ("dist/package.json", "{}"),
        ("work/go.work", "use (\n ./a\n ./b\n)\n"), ("work/go.mod", "module m"), ("work/a/go.mod", ""), ("work/b/go.mod", ""),
        ("js/package.json", '{"workspaces":["old/*"]}'), ("js/pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n"), ("js/packages/p/package.json", "{}"), ("js/old/o/package.json", "{}"),
        ("plain/package.json", '{"workspaces":["w/*"]}'), ("plain/pnpm-workspace.yaml", "allowBuilds:\n  x: true\n"), ("plain/w/z/package.json", "{}"), ("plain/w/y/package.json", "{}"),
        ("net/App.sln", 'Project("{F}") = "A", "src\\A\\A.csproj", "{G}"'), ("net/src/A/A.csproj", ""), ("void/Void.sln", ""), ("void/V.csproj", ""),
        ("jvm/gradle/libs.versions.toml", ""), ("jvm/settings.gradle.kts", 'include(":lib")'), ("jvm/lib/build.gradle.kts", ""), ("x/y/mv/pom.xml", POM.format("<module>m1</module><module>gone</module>")), ("x/y/mv/m1/pom.xml", "<project/>"),
        ("a/b/c/d/e/f/g/h/i/package.json", "{}"),
    ]
    assert scanned(spark, files) == [
        (("app", "pom.xml"), ["app/pom.xml"]), (("js", "package.json"), ["js/package.json", "js/packages/p/package.json"]), (("jvm", "libs.versions.toml"), ["jvm/gradle/libs.versions.toml"]),
        (("net", "sln"), ["net/src/A/A.csproj"]), (("plain", "package.json"), ["plain/package.json", "plain/w/y/package.json", "plain/w/z/package.json"]), (("void", "csproj"), ["void/V.csproj"]),
        (("work", "go.work"), ["work/a/go.mod", "work/b/go.mod"]), (("x/y/mv", "pom.xml"), ["x/y/mv/pom.xml", "x/y/mv/m1/pom.xml"]),
    ]
    assert scanned(spark, [("package.json", "{}"), ("b/pom.xml", "<project/>")]) == [(("", "package.json"), ["package.json"])]
    assert scanned(spark, [("readme.md", "x")]) == []
