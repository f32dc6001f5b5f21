"""More of the engine's operators on the driver's tables, with the same questions in DuckDB SQL.

Suppliers and nations stand for projects and repositories: manifests, pages and POMs are written from their columns, read
by the engine's parsers, and compared with what the columns say.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.functions import vector as vec
from quarrylight.operators import citations as ci
from quarrylight.operators import dependencies as dep
from quarrylight.operators import documents as doc
from quarrylight.operators import graph as gr
from quarrylight.operators.scratch import scratch_path
from quarrylight.plans.inventory import inventory_page, project_dependencies
from quarrylight.plans.queries import load, registered
from quarrylight.plans.store import Store, upserted
from quarrylight.sources import manifests, workspaces
from quarrylight.streaming import feeds, leases

#: A file of each format by name, ``@`` being the supplier's number, and the rows that its parser must return.
FILES = {
    "package.json": ('{"dependencies":{"b-@":"^@.0","a":"1"},"devDependencies":{"d":"1"},"optionalDependencies":{"o-@":"~2"}}', [("b-@", "npm", "^@.0", "runtime"), ("a", "npm", "1", "runtime"), ("o-@", "npm", "~2", "optional")]),
    "requirements.txt": ('# c\nreq-@>=@.1,<9 ; python_version > "3"\n-e git+x\n', [("req-@", "pypi", ">=@.1,<9", "runtime")]),
    "pyproject.toml": ('[project]\ndependencies = ["py-@==@.2"]\n', [("py-@", "pypi", "==@.2", "runtime")]),
    "poetry/pyproject.toml": ('[tool.poetry.dependencies]\npython = "^3"\npo-@ = "^@"\n', [("po-@", "pypi", "^@", "runtime")]),
    "go.mod": ("module x\nrequire (\n  github.com/o/m-@ v@.0.0\n  github.com/o/i v1.0.0 // indirect\n)\n", [("github.com/o/m-@", "go", "v@.0.0", "runtime")]),
    "Cargo.toml": ('[dependencies]\nc-@ = "@.1"\nt = { version = "2" }\n[dev-dependencies]\ndd = "1"\n', [("c-@", "cargo", "@.1", "runtime"), ("t", "cargo", "2", "runtime")]),
    "composer.json": ('{"require":{"php":">=8","v/p-@":"^@"},"require-dev":{"v/d":"1"}}', [("v/p-@", "composer", "^@", "runtime")]),
    "pom.xml": ("<project><properties><v>@.3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a-@</artifactId><version>${v}</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>", [("g:a-@", "maven", "@.3", "runtime")]),
    "gradle/libs.versions.toml": ('[versions]\nk = "@.4"\n[libraries]\na = { module = "g:l-@", version.ref = "k" }\n', [("g:l-@", "maven", "@.4", "runtime")]),
    "build.gradle": ("dependencies {\n implementation 'g:b-@:@.5'\n api(\"g:n-@\")\n implementation \"g:x:$v\"\n}", [("g:b-@", "maven", "@.5", "runtime"), ("g:n-@", "maven", None, "runtime")]),
    "build.gradle.kts": ('dependencies { implementation(group = "g", name = "k-@", version = "@.6") }', [("g:k-@", "maven", "@.6", "runtime")]),
    "Gemfile.lock": ("GEM\n  specs:\n    rake (1)\n\nDEPENDENCIES\n  gem-@ (~> @)\n  own!\n", [("gem-@", "gem", "~> @", "runtime"), ("own", "gem", None, "runtime")]),
    "Gemfile": ("gem 'ruby-@', '~> @'\ngroup :test do\n  gem 'rspec'\nend\n", [("ruby-@", "gem", "~> @", "runtime")]),
    "x.csproj": ('<Project><ItemGroup><PackageReference Include="P-@" Version="@.7"/></ItemGroup></Project>', [("P-@", "nuget", "@.7", "runtime")]),
}


def quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def numbered(text: str, number: Column) -> Column:
    return F.replace(F.lit(text), F.lit("@"), number.cast("string"))


FOUND_SQL = ", ".join(f"({quoted(path)}, {pos}, {', '.join(quoted(x) for x in row)})" for path, (_, rows) in FILES.items() for pos, row in enumerate(rows))


@registered(f"""with f(path, pos, name, ecosystem, declared_version, kind) as (values {FOUND_SQL})
select 'p' || s_suppkey || '/' || path as manifest_path, pos::int as pos, replace(name, '@', s_suppkey::varchar) as name, ecosystem, replace(declared_version, '@', s_suppkey::varchar) as declared_version, kind from supplier, f""")
def manifest_rows(spark, sf_dir):
    """A manifest of each format a supplier, through the parsers."""
    key = F.col("s_suppkey")
    made = F.array(*[F.struct(F.concat(F.lit("p"), key.cast("string"), F.lit("/" + path)).alias("path"), numbered(text, key).alias("content")) for path, (text, _) in FILES.items()])
    files = load(spark, sf_dir, "supplier").select(F.explode(made).alias("f")).select("f.*")
    return manifests.read_manifests(files).where("error is null").drop("error")


@registered("""with files(p, name) as (values (1, '/pom.xml'), (2, '/App.sln'), (3, '/A.csproj'), (4, '/Cargo.toml'), (5, '/composer.json'), (6, '/go.work'), (7, '/go.mod'), (8, '/pyproject.toml'), (9, '/package.json'), (10, '/Gemfile.lock')),
-- A folder a supplier, with the manifests of every second to last place that its key leaves; the order is the documented one.
there as (select 'p' || s_suppkey as folder, p, 'p' || s_suppkey || name as path from supplier, files where (s_suppkey * 7 + p * p) % 5 < 2 or p = 10)
select folder, arg_min(path, p) as path from there group by folder
union all select 'c' || s_suppkey, 'c' || s_suppkey || '/gradle/libs.versions.toml' from supplier where s_suppkey % 2 = 0""")
def primary_manifests(spark, sf_dir):
    key = F.col("s_suppkey")
    names = ["/pom.xml", "/App.sln", "/A.csproj", "/Cargo.toml", "/composer.json", "/go.work", "/go.mod", "/pyproject.toml", "/package.json", "/Gemfile.lock"]
    there = [F.when(((key * 7 + p * p) % 5 < 2) | F.lit(p == 10), F.concat(F.lit("p"), key.cast("string"), F.lit(n))) for p, n in enumerate(names, 1)]
    there += [F.when(key % 2 == 0, F.concat(F.lit("c"), key.cast("string"), F.lit(n))) for n in ("/gradle/libs.versions.toml", "/README.md")]
    files = load(spark, sf_dir, "supplier").select(F.explode(F.array_compact(F.array(*there))).alias("path")).withColumn("content", F.lit(""))
    return manifests.primary_manifest(files).select("folder", "path")


@registered("""with s as (select s_suppkey as k, s_nationkey as n, 'p' || s_suppkey as root, row_number() over (order by 'p' || s_suppkey) - 1 as idx from supplier),
found as (
    select idx, root, 'package.json' as type, root || '/package.json' as path, 'lib-' || (k % 7) as name, 'npm' as ecosystem, k::varchar as version from s where k % 3 <> 0
    union all select idx, root, 'package.json', root || '/package.json', 'n' || n, 'npm', '1' from s where k % 3 <> 0
    union all select idx, root, 'package.json', root || '/packages/a/package.json', 'm' || k, 'npm', '2' from s where k % 3 <> 0
    union all select idx, root, 'pom.xml', root || '/pom.xml', 'g:a' || k, 'maven', '1.' || k from s where k % 3 = 0)
select idx::int as manifest_idx, root as project_root, type as manifest_type, path as manifest_path, name, ecosystem, version as declared_version,
       (select count(*) from found where idx = 0) as total, (select count(*) from found) as manifests_total from found""")
def project_inventory(spark, sf_dir):
    """The whole page of a project with a folder a supplier: a workspace with a member that declares a dependency again, for every third a POM that goes
    before it, and manifests in folders below a root or in ignored ones."""
    key, root = F.col("s_suppkey").cast("string"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))
    made = lambda path, *content: F.struct(F.concat(root, F.lit(path)).alias("path"), F.concat(*[F.lit(c) if isinstance(c, str) else c for c in content]).alias("content"))
    lib = (F.col("s_suppkey") % 7).cast("string")
    files = [
        made("/package.json", '{"dependencies": {"lib-', lib, '": "', key, '", "n', F.col("s_nationkey").cast("string"), '": "1"}, "devDependencies": {"d": "1"}, "workspaces": ["packages/*"]}'),
        made("/packages/a/package.json", '{"dependencies": {"lib-', lib, '": "old", "m', key, '": "2"}}'), made("/deep/go.mod", "require x.org/y v1"),
        F.when(F.col("s_suppkey") % 3 == 0, made("/pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a", key, "</artifactId><version>1.", key, "</version></dependency></dependencies></project>")),
        F.when(F.col("s_suppkey") % 5 == 0, made("/node_modules/z/package.json", '{"dependencies": {"hidden": "1"}}')),
    ]
    table = load(spark, sf_dir, "supplier").select(F.explode(F.array_compact(F.array(*files))).alias("f")).select("f.*")
    page = inventory_page(project_dependencies(table, False, True), False, 0, 50)
    return page.select("manifest_idx", "project_root", "manifest_type", "manifest_path", "name", "ecosystem", "declared_version", "total", "manifests_total")


@registered("""select 's' || s_suppkey || '/package.json' as root, 's' || s_suppkey || '/packages/' || m || '/package.json' as member, (case m when 'a' then 0 else 1 end)::int as pos
from supplier, (values ('a'), ('c')) v(m)""")
def workspace_packages(spark, sf_dir):
    """Members of a workspace: a glob, with one folder taken away and one without a manifest."""
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    root = F.lit('{"workspaces":["packages/*","!packages/b"]}')
    made = [("/package.json", root), *[(f"/packages/{m}/package.json", F.lit("{}")) for m in "cab"], ("/packages/d/notes.txt", F.lit("")), ("/other/package.json", F.lit("{}"))]
    rows = F.array(*[F.struct(F.concat(key, F.lit(path)).alias("path"), content.alias("content")) for path, content in made])
    return workspaces.workspace_members(load(spark, sf_dir, "supplier").select(F.explode(rows).alias("f")).select("f.*")).select("root", "member", "pos")


@registered("""select 's' || s_suppkey || '/Web.csproj' as manifest_path, 'Lib' as name, case when s_suppkey % 3 = 0 then '9' else s_suppkey || '.0' end as declared_version from supplier
union all select 's' || s_suppkey || '/deep/App.csproj', 'Lib', s_suppkey || '.0' from supplier""")
def central_package_versions(spark, sf_dir):
    """References without a version get that of the nearest central file above."""
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    suppliers = load(spark, sf_dir, "supplier")
    central = numbered('<Project><ItemGroup><PackageVersion Include="Lib" Version="@.0"/></ItemGroup></Project>', F.col("s_suppkey"))
    props = suppliers.select(F.concat(key, F.lit("/Directory.Packages.props")).alias("path"), central.alias("content"))
    props = props.unionByName(spark.createDataFrame([("Directory.Packages.props", '<Project><ItemGroup><PackageVersion Include="Lib" Version="0"/></ItemGroup></Project>')], "path string, content string"))
    refs = suppliers.select(F.concat(key, F.lit("/Web.csproj")).alias("manifest_path"), F.lit("Lib").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "9").alias("declared_version"))
    refs = refs.unionByName(suppliers.select(F.concat(key, F.lit("/deep/App.csproj")).alias("manifest_path"), F.lit("Lib").alias("name"), F.lit(None).cast("string").alias("declared_version")))
    return workspaces.central_versions(refs, props).select("manifest_path", "name", "declared_version")


@registered("""with recursive imports(project, gav, pos) as (
    select 'n' || n_nationkey, 'b' || n_nationkey, 0 from nation union all select 'n' || n_nationkey, 'b' || (n_nationkey + 7) % 25, 1 from nation where n_nationkey % 3 = 0),
edges(gav, child, pos) as (
    select 'b' || n_nationkey, 'b' || (n_nationkey * 2) % 25, 0 from nation union all select 'b' || n_nationkey, 'b' || (n_nationkey + 1) % 25, 1 from nation where n_nationkey % 4 = 1),
walk(project, gav, path, depth) as (
    select project, gav, [pos], 0 from imports union all select w.project, e.child, list_append(w.path, e.pos), w.depth + 1 from walk w join edges e on e.gav = w.gav where w.depth + 1 < 5),
seen as (select project, gav, min(depth) as depth, arg_min(path, (depth, path)) as path from walk group by project, gav),
managed(gav, coord, version, pos) as (
    select 'b' || (p_partkey % 25), 'g:' || (p_partkey % 40), p_partkey || '.0', p_partkey from part)
select project, coord, arg_min(version, (depth, list_transform(path, lambda x: -x), -pos)) as version, min(depth)::int as depth
from seen join managed using (gav) group by project, coord""")
def bom_version_map(spark, sf_dir):
    """The closure over bills of materials with cycles: nearer levels win, then later siblings, then later entries."""
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    nations, n = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    imports = nations.select(name("n", n).alias("project"), name("b", n).alias("gav"), F.lit(0).alias("pos"))
    imports = imports.unionByName(nations.where(n % 3 == 0).select(name("n", n).alias("project"), name("b", (n + 7) % 25).alias("gav"), F.lit(1).alias("pos")))
    edges = nations.select(name("b", n).alias("gav"), name("b", (n * 2) % 25).alias("child"), F.lit(0).alias("pos"))
    edges = edges.unionByName(nations.where(n % 4 == 1).select(name("b", n).alias("gav"), name("b", (n + 1) % 25).alias("child"), F.lit(1).alias("pos")))
    key = F.col("p_partkey")
    managed = load(spark, sf_dir, "part").select(name("b", key % 25).alias("gav"), name("g:", key % 40).alias("coord"), F.concat(key.cast("string"), F.lit(".0")).alias("version"), key.alias("pos"))
    return dep.bom_versions(imports, managed, edges).select("project", "coord", "version", "depth")


@registered("""with p as (select p_partkey as k, ['npm', 'pypi', 'cargo', 'go', 'maven'][(p_partkey % 5 + 1)::int] as ecosystem, (p_partkey % 4)::int as answer, p_partkey from part)
select case ecosystem when 'go' then 'github.com/o' || k || '/r' when 'maven' then 'g:a' || k else 'pkg' || k end as name, ecosystem,
       case when answer = 1 then null when ecosystem = 'go' then case when answer <> 2 then 'o' || k end when ecosystem = 'maven' then case when answer <> 2 then 'own' || k end when answer = 2 then 'pkg' || k else 'own' || k end as owner,
       case when answer = 1 then null when ecosystem = 'go' then case when answer <> 2 then 'r' end when ecosystem = 'maven' then case when answer <> 2 then 'repo' end when answer = 2 then 'pkg' || k else 'repo' end as repo,
       case when answer = 1 then null when answer = 2 then case when ecosystem in ('go', 'maven') then null else 'low' end else 'high' end as confidence
from p""")
def registry_repos(spark, sf_dir):
    """Packages by captured answers: found, unknown (404), failed (500) and found again."""
    k = F.col("p_partkey")
    ecosystem = F.element_at(F.array(*[F.lit(e) for e in ("npm", "pypi", "cargo", "go", "maven")]), (k % 5 + 1).cast("int"))
    n = k.cast("string")
    name = F.when(ecosystem == "go", F.concat(F.lit("github.com/o"), n, F.lit("/r"))).when(ecosystem == "maven", F.concat(F.lit("g:a"), n)).otherwise(F.concat(F.lit("pkg"), n))
    url = F.concat(F.lit("https://github.com/own"), n, F.lit("/repo.git"))
    wrap = lambda before, after: F.concat(F.lit(before), url, F.lit(after))
    answer = F.when(ecosystem == "npm", wrap('{"repository":{"type":"git","url":"git+', '"}}')).when(ecosystem == "pypi", wrap('{"info":{"project_urls":{"Source":"', '"}}}')).when(ecosystem == "cargo", wrap('{"crate":{"repository":"', '"}}')).when(ecosystem == "maven", wrap('{"scm":{"url":"scm:git:', '"}}')).otherwise("{}")
    status = F.when(k % 4 == 1, 404).when(k % 4 == 2, 500).otherwise(200)
    rows = load(spark, sf_dir, "part").select(name.alias("name"), ecosystem.alias("ecosystem"), status.alias("http_status"), answer.alias("json"))
    return dep.resolve_repos(rows.select("name", "ecosystem"), rows).select("name", "ecosystem", "owner", "repo", "confidence")


@registered("""select 'pkg' || p_partkey as name, case when p_partkey % 3 > 0 then 'o/r' || p_partkey % 30 end as resolved, case when p_partkey % 3 > 0 and p_partkey % 30 < 20 then p_partkey % 30 < 10 end as has_wiki from part where p_partkey % 7 <> 0""")
def wiki_probe(spark, sf_dir):
    """Dependencies of the wanted kinds with their repository and what is known of its wiki."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    parts = load(spark, sf_dir, "part")
    deps = parts.select(F.concat(F.lit("pkg"), n).alias("name"), F.lit("npm").alias("ecosystem"), F.when(k % 7 == 0, "dev").when(k % 7 == 1, "optional").when(k % 7 == 2, "runtime").alias("kind"))
    repos = parts.where(k % 3 > 0).select(F.concat(F.lit("pkg"), n).alias("query"), F.lit("npm").alias("ecosystem"), F.lit("o").alias("owner"), F.concat(F.lit("r"), (k % 30).cast("string")).alias("repo"), F.lit("npm-registry").alias("source"), F.lit("high").alias("confidence"))
    status = spark.range(20).select(F.concat(F.lit("o/r"), F.col("id").cast("string")).alias("repo"), (F.col("id") < 10).alias("has_wiki"), F.lit(1).alias("page_count"))
    return dep.resolve_and_probe(dep.wanted_kinds(deps), repos, status).select("name", "resolved", "has_wiki")


@registered("""with r as (select 'f' || l_partkey % 700 as path, l_linenumber % 3 as class, l_suppkey as root_idx, l_orderkey as pos from lineitem),
f as (select * from (select *, row_number() over (partition by path order by class, root_idx, pos) as n from r) where n = 1)
select path, class::int as class, root_idx, pos from f order by class, root_idx, pos limit 512""")
def watched_paths(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), (F.col("l_partkey") % 700).cast("string")).alias("path"), (F.col("l_linenumber") % 3).cast("int").alias("class"), F.col("l_suppkey").alias("root_idx"), F.col("l_orderkey").alias("pos"))
    return dep.watch_set(rows).select("path", "class", "root_idx", "pos")


@registered("""with f as (select distinct list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/?[^/]*$', ''), '/'), lambda x: x <> '') as parts from pages),
ok as (select * from f where len(parts) <= 8 and not list_has_any(parts, ['node_modules', '.git', 'dist', 'build', 'target', 'vendor', '.venv', 'venv', '__pycache__', '.next', '.gradle', 'bin', 'obj']))
select array_to_string(parts, '/') as folder, len(parts)::int as depth from ok a
where not exists (select 1 from ok b where len(b.parts) < len(a.parts) and b.parts = a.parts[1:len(b.parts)])""")
def top_folders(spark, sf_dir):
    """Folders of the pages' paths that are below no other: where scans of projects begin."""
    return dep.project_roots(load(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


SHA = "0123456789abcdef0123456789abcdef01234567"


def wiki_nodes(spark, sf_dir) -> DataFrame:
    """A page a supplier: two sections with code, prose with links, a diagram, and prose that names a section it is not in."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    base = tx.WIKI_BASE
    github = F.struct(F.concat(F.lit("o/r"), (k + 1).cast("string")).alias("repo"), F.lit(SHA).alias("sha"), F.concat(F.lit("src/f"), n, F.lit(".py")).alias("path"), F.lit("L1").alias("line_range"))
    prose = F.concat(F.lit(f"See [two](#s2) and [other]({base}o/x"), n, F.lit("#top) and [code](https://github.com/o/r"), n, F.lit(f"/blob/{SHA}/lib/a.py#L3-L9)."))
    diagram = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label")) for i, label in (("a", "A"), ("b", "B"), ("x::y", "no"))])
    arrows = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(label).alias("label")) for a, b, label in (("a", "b", "calls"), ("a", "zz", ""))])
    null = lambda kind: F.lit(None).cast(kind)
    columns = {
        "type": null("string"), "section_slug": null("string"), "slug": null("string"), "title": null("string"), "level": null("int"), "parent_slug": null("string"), "has_diagrams": null("boolean"), "markdown": null("string"), "language": null("string"), "text": null("string"),
        "github": F.lit(None).cast("struct<repo: string, sha: string, path: string, line_range: string>"), "svg_base64": null("string"), "mermaid": null("string"), "source_url": null("string"), "lossy": null("boolean"),
        "nodes": F.lit(None).cast("array<struct<id: string, label: string>>"), "edges": F.lit(None).cast("array<struct<from: string, to: string, label: string>>"),
    }
    heading = lambda slug, level: {"type": F.lit("heading"), "section_slug": F.lit(slug), "slug": F.lit(slug), "title": F.concat(F.lit(f"Part {slug} of "), n), "level": F.lit(level), "has_diagrams": F.lit(False)}
    made = [
        heading("s1", 1), {"type": F.lit("code"), "section_slug": F.lit("s1"), "language": F.lit("py"), "text": F.concat(F.lit("x = "), n), "github": github},
        {"type": F.lit("prose"), "section_slug": F.lit("s1"), "markdown": prose}, heading("s2", 2), {"type": F.lit("diagram"), "section_slug": F.lit("s2"), "nodes": diagram, "edges": arrows, "lossy": F.lit(False)},
        {"type": F.lit("prose"), "section_slug": F.lit("s9"), "markdown": F.lit("[lost](#s1)")},
    ]
    rows = [F.struct(F.concat(F.lit("o/r"), n).alias("repo"), F.lit("__root__").alias("page_slug"), F.lit(i).alias("seq"), *[own.get(c, empty).alias(c) for c, empty in columns.items()]) for i, own in enumerate(made)]
    return load(spark, sf_dir, "supplier").select(F.explode(F.array(*rows)).alias("node")).select("node.*")


@registered(f"""with s as (select 'o/r' || s_suppkey as repo, s_suppkey as k from supplier),
e as (
    select repo, 'section' as src_kind, repo || '#s1' as src_id, 'file' as dst_kind, 'o/r' || (k + 1) || ':src/f' || k || '.py' as dst_id, 'code_ref' as edge_type, '{SHA}' as sha, 'L1' as line_range, null as label, null as anchor_text, null as anchor, null as file_path, '' as kinds from s
    union all select repo, 'section', repo || '#s1', 'repo', 'o/r' || (k + 1), 'cross_repo_ref', '{SHA}', null, null, null, null, 'src/f' || k || '.py', 'code_block' from s
    union all select repo, 'section', repo || '#s1', 'section', repo || '#s2', 'section_link', null, null, null, 'two', null, null, '' from s
    union all select repo, 'section', repo || '#s1', 'repo', 'o/x' || k, 'cross_repo_ref', null, null, null, 'other', 'top', null, 'anchor_link' from s
    union all select repo, 'section', repo || '#s1', 'file', repo || ':lib/a.py', 'code_ref', '{SHA}', 'L3-L9', null, null, null, null, '' from s
    union all select repo, 'section', repo || '#s2', 'diagram_node', repo || '#s2::a', 'diagram_member', null, null, 'A', null, null, null, '' from s
    union all select repo, 'section', repo || '#s2', 'diagram_node', repo || '#s2::b', 'diagram_member', null, null, 'B', null, null, null, '' from s
    union all select repo, 'diagram_node', repo || '#s2::a', 'diagram_node', repo || '#s2::b', 'diagram_edge', null, null, 'calls', null, null, null, '' from s)
select * from e""")
def page_edges(spark, sf_dir):
    """The five types of edges of a wiki."""
    edges = gr.extract_edges(wiki_nodes(spark, sf_dir))
    return edges.select("repo", "src_kind", "src_id", "dst_kind", "dst_id", "edge_type", *[f"metadata.{c}" for c in ("sha", "line_range", "label", "anchor_text", "anchor", "file_path")], F.array_join("metadata.kinds", ",").alias("kinds"))


@registered("""select edge_type, n * (select count(*) from supplier) as n from (values ('code_ref', 2), ('cross_repo_ref', 2), ('section_link', 1), ('diagram_member', 2), ('diagram_edge', 1)) v(edge_type, n)""")
def edge_type_counts(spark, sf_dir):
    return gr.edge_counts(gr.extract_edges(wiki_nodes(spark, sf_dir)))


@registered("""select 'o/r3' as repo, null as source_node_id, 'o/r3#s2::a' as dst_id, 1 as pos union all select 'o/r3', null, 'o/r3#s2::b', 2 union all select 'o/r3', 'o/r3#s2::a', 'o/r3#s2::b', 3""")
def diagram_members(spark, sf_dir):
    return gr.diagram_neighbours(gr.extract_edges(wiki_nodes(spark, sf_dir)), "o/r3", "s2").select("repo", "source_node_id", "dst_id", "pos")


@registered(f"""with s as (select count(*) as n from supplier)
select 'o/r4' as repo, 'o/r5' as other, 'o/r4#s1' as from_sections, 'code_block' as kinds, case when 5 < n then 'known5' else '{SHA}' end as sha, 'out' as direction, 1 as pos from s
union all select 'o/r4', 'o/x4', 'o/r4#s1', 'anchor_link', '', 'out', 2
union all select 'o/r4', 'o/r3', 'o/r3#s1', '', 'known3', 'in', 3""")
def cross_repo_question(spark, sf_dir):
    """What a repository refers to and what refers to it; the commit of the index counts before the edge's own."""
    edges = gr.extract_edges(wiki_nodes(spark, sf_dir))
    status = load(spark, sf_dir, "supplier").select(F.concat(F.lit("o/r"), F.col("s_suppkey").cast("string")).alias("repo"), F.concat(F.lit("known"), F.col("s_suppkey").cast("string")).alias("commit_sha"), F.lit(1).alias("edge_count"))
    rows = gr.find_neighbours(edges, gr.ready(status), "cross_repo", repo="o/r4")
    return rows.select("repo", "other", F.array_join("from_sections", ",").alias("from_sections"), F.array_join("kinds", ",").alias("kinds"), "sha", "direction", "pos")


@registered(f"""select 'o/r' || s_suppkey as repo, 's1' as section_slug, 0 as ordinal, '# Part s1 of ' || s_suppkey || E'\\n\\n```py\\nx = ' || s_suppkey || E'\\n```\\n_Source: https://github.com/o/r' || (s_suppkey + 1) || '/blob/{SHA}/src/f' || s_suppkey || E'.py#L1_\\n\\nSee [two](#s2) and [other]({tx.WIKI_BASE}o/x' || s_suppkey || '#top) and [code](https://github.com/o/r' || s_suppkey || '/blob/{SHA}/lib/a.py#L3-L9).' || E'\\n' as text, 'o/r' || (s_suppkey + 1) as github_repo from supplier
union all select 'o/r' || s_suppkey, 's2', 0, '## Part s2 of ' || s_suppkey || E'\\n\\n> Diagram (text fallback)\\n>\\n> nodes: a="A", b="B", x::y="no"\\n> edges: a -> b [calls], a -> zz\\n', null from supplier""")
def section_chunks(spark, sf_dir):
    """Chunks of a wiki's sections: their nodes' Markdown, and the file they are from if one code node says so."""
    return doc.chunks(wiki_nodes(spark, sf_dir)).select("repo", "section_slug", "ordinal", "text", "github_repo")


@registered("""select 'o/r' || s_suppkey as repo, slug, 'Part ' || slug || ' of ' || s_suppkey as title, level::int as level from supplier, (values ('s1', 1), ('s2', 2)) v(slug, level)""")
def page_contents(spark, sf_dir):
    return doc.contents(wiki_nodes(spark, sf_dir)).select("repo", "slug", "title", "level")


@registered(f"""select 'o/r' || s_suppkey as repo, '{tx.WIKI_BASE}o/r' || s_suppkey || '#s' || s_nationkey as source_url, '2024-01-01T00:00:00.000Z' as last_checked,
       s_name || E'\\n\\n---\\n*Source: {tx.WIKI_BASE}o/r' || s_suppkey || '#s' || s_nationkey || ' (generated text, pinned to commit {SHA})*' as text from supplier""")
def cited_rows(spark, sf_dir):
    """Citations in place of older ones."""
    repo, slug = F.concat(F.lit("o/r"), F.col("s_suppkey").cast("string")), F.concat(F.lit("s"), F.col("s_nationkey").cast("string"))
    older = F.when(F.col("s_suppkey") % 2 == 0, ci.footer(F.concat(F.lit(tx.WIKI_BASE), repo), F.lit("f" * 40))).otherwise(F.lit(""))
    rows = load(spark, sf_dir, "supplier").select(repo.alias("repo"), slug.alias("section_slug"), F.lit(SHA).alias("commit_sha"), F.concat("s_name", older).alias("text"))
    return ci.cited(rows, 1_704_067_200_000).select("repo", "source_url", "last_checked", "text")


@registered("""select c_custkey as repo, case when c_custkey % 4 = 0 and c_custkey % 5 > 2 then 'cached' when c_custkey % 7 = 0 then 'invalidate' when c_custkey % 11 = 0 then 'retry'
    when c_custkey % 4 > 0 then 'store' when c_custkey % 3 = 0 then 'touch' else 'replace' end as action from customer""")
def page_actions(spark, sf_dir):
    """What to do with a fetched page, by the cached one."""
    k, customers = F.col("c_custkey"), load(spark, sf_dir, "customer")
    old = customers.where(k % 4 == 0).select(k.alias("repo"), F.when(k % 5 > 2, 1000).otherwise(10).cast("long").alias("fetched_at_ms"), F.lit("a").alias("commit_sha"))
    fetched = customers.select(k.alias("repo"), (k % 7 == 0).alias("not_found"), (k % 11 == 0).alias("empty_shell"), F.when(k % 3 == 0, "a").otherwise("b").alias("first_commit_sha"))
    return doc.page_index(old, fetched, now_ms=1500, ttl_ms=1000).select("repo", "action")


#: URLs, ``~`` being the number, and the repositories that they name.
URLS = [("https://github.com/o~/r~.git", "o~/r~"), ("git+https://github.com/o~/r~", "o~/r~"), ("git@github.com:o~/r~.git", "o~/r~"), ("ssh://git@github.com/o~/r~", "o~/r~"), ("o~/r~", "o~/r~"), ("https://gitlab.com/o~/r~", None), ("https://github.com/o~", None), ("https://github.com/o~/r~/tree/main#x", "o~/r~")]
URLS_SQL = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in URLS)


@registered(f"""with u(url, repo) as (values {URLS_SQL}), all_ as (select replace(url, '~', s_suppkey::varchar) as url, replace(repo, '~', s_suppkey::varchar) as repo from supplier, u)
select url, repo, case when not contains(url, '/') then url || '/' || url when regexp_matches(url, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') then url end as guess from all_""")
def repository_names(spark, sf_dir):
    urls = F.array(*[F.replace(F.lit(a), F.lit("~"), F.col("s_suppkey").cast("string")) for a, _ in URLS])
    rows = load(spark, sf_dir, "supplier").select(F.explode(urls).alias("url"))
    return rows.select("url", tx.github_repo(F.col("url")).alias("repo"), tx.fuzzy_repo(F.col("url")).alias("guess"))


@registered(f"""select s_suppkey as k, 'o/r#s' || s_suppkey as section, 's' || s_suppkey as slug, '#s' || s_suppkey || '::n' as short, s_suppkey % 2 = 0 as commit, 'c++' as language,
       'o/r' || s_suppkey || ':a.py@' || 'L' || s_suppkey as blob from supplier""")
def identifiers(spark, sf_dir):
    """Identifiers of sections, files and diagram nodes, and their parts."""
    n = F.col("s_suppkey").cast("string")
    slug = F.concat(F.lit("s"), n)
    node = tx.diagram_node_id(F.lit("o/r"), slug, F.lit("n"))
    links = tx.blob_links(F.concat(F.lit("text https://github.com/o/r"), n, F.lit(f"/blob/{SHA}/a.py#L"), n, F.lit(" and https://github.com/o/r/tree/main")))
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), tx.section_id(F.lit("o/r"), slug).alias("section"), tx.slug_of(node).alias("slug"), F.concat(F.lit("#"), tx.strip_repo(node, F.lit("o/r"))).alias("short"),
        tx.is_commit(F.when(F.col("s_suppkey") % 2 == 0, SHA).otherwise("main")).alias("commit"), tx.language_of(F.lit("hl language-c++")).alias("language"),
        F.array_join(F.transform(links, lambda x: F.concat(tx.file_id(x["repo"], x["path"]), F.lit("@"), x["line_range"])), ",").alias("blob"))


@registered("""with q as (select embedding::double[] as q from embeddings where vec_id = 0), e as (select vec_id, embedding::double[] as v, q from embeddings, q where vec_id % 5 <> 0),
s as (select 'n' || vec_id as node_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) as score, vec_id from e)
select node_id, pos::int as pos from (
    select 'n' || v.vec_id as node_id, row_number() over (order by s.score is null, s.score desc, v.vec_id) as pos from embeddings v left join s on s.vec_id = v.vec_id where v.vec_id < 200)""")
def semantic_neighbours(spark, sf_dir):
    """Neighbours by likeness to a vector; those without one keep their order at the end."""
    table = load(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("node_id")
    target = table.where("vec_id = 0").first()["embedding"]
    return gr.semantic_order(table.where("vec_id < 200").select(name, F.col("vec_id").alias("pos")), table.where("vec_id % 5 <> 0").select(name, F.col("embedding").alias("vector")), target).select("node_id", "pos")


@registered("""select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as length from embeddings""")
def vector_lengths(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("length"))


@registered("""with t as (select event_id, user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select user_id as key, event_id, value from t where n = 1""")
def upserted_pages(spark, sf_dir):
    """A table of pages after all changes: of each key the last one."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value", F.struct("ts", "event_id").alias("turn"))
    old = events.select("key", F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value")).distinct()
    return upserted(old, events, ["key"])


@registered("""-- A repository without a document of the second build keeps its first.
with d as (select source as repo, doc_id, length(source) = 4 and bool_or(doc_id % 2 = 0) over (partition by source) as again from documents where source is not null)
select repo, count(*) filter (where not again or doc_id % 2 = 0) as chunks, count(*) filter (where doc_id % 3 = 0 and (not again or doc_id % 2 = 0)) as edges,
       case when again then 20 else 10 end::bigint as indexed_at_ms, count(*) filter (where not again or doc_id % 2 = 0) as postings from d where repo <> 'src1' group by repo, again""")
def store_rebuilds(spark, sf_dir):
    """Repositories after a build of all, a second one of some, and a drop: what a reader of the store sees. Documents are chunks of their source, their
    language is the text; every third has an edge."""
    store = Store(spark, scratch_path(spark, "store"), 2)
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    docs = load(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("repo"), "doc_id", F.coalesce("lang", F.lit("en")).alias("text"), F.col("doc_id").cast("string").alias("section"))

    def build(some: DataFrame, now_ms: int) -> None:
        chunks = some.select("repo", F.lit("p").alias("page_slug"), F.col("section").alias("section_slug"), F.lit(0).alias("ordinal"), "text", *none(*[f"github_{c}" for c in ("repo", "sha", "path", "line_range")]), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(now_ms).cast("long").alias("indexed_at_ms"), F.lit(SHA).alias("commit_sha"))
        meta = F.struct(*none(*gr.FIELDS), F.array().cast("array<string>").alias("kinds")).alias("metadata")
        edges = some.where("doc_id % 3 = 0").select(F.lit("section").alias("src_kind"), F.col("section").alias("src_id"), F.lit("section").alias("dst_kind"), F.lit("b").alias("dst_id"), F.lit("section_link").alias("edge_type"), "repo", meta, F.lit(SHA).alias("commit_sha"), F.lit(now_ms).cast("long").alias("indexed_at_ms"))
        store.rebuild_many(chunks, edges, some.select("repo", F.lit(SHA).alias("commit_sha")).distinct(), now_ms)

    build(docs, 10)
    build(docs.where("length(repo) = 4 and doc_id % 2 = 0"), 20)
    store.drop("src1", 99)
    counted = lambda rows, name: rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    posted = store.postings()[0].groupBy("repo").agg(F.sum("n").alias("postings"))
    out = store.status().select("repo", "indexed_at_ms").join(counted(store.chunks(), "chunks"), "repo", "left").join(counted(store.edges(), "edges"), "repo", "left").join(posted, "repo", "left")
    return out.select("repo", "chunks", F.coalesce("edges", F.lit(0)).alias("edges"), "indexed_at_ms", "postings")


@registered("""select (epoch_us(ts) // 30000000 * 30000)::bigint as window_ms, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""")
def streamed_windows(spark, sf_dir):
    """Tumbling windows as a stream: all that is there, then the stream ends."""
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    schema = load(spark, sf_dir, "events").schema
    # A stream reads folders; the table is one file of the folder.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "windows")
    feeds.tumbling(events, ["event_type"]).writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n", F.round("total", 2).alias("total"))


@registered("""select user_id::varchar as repo, max(epoch_us(ts) // 1000)::bigint as indexed_at_ms, max(epoch_us(ts) // 1000) > (select max(epoch_us(ts) // 1000) from events) - 86400000 as fresh from events group by user_id""")
def expiring_indexes(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return feeds.expiring(events.groupBy("repo").agg(F.max("ms").alias("indexed_at_ms")), events.agg(F.max("ms")).first()[0] or 0).select("repo", "indexed_at_ms", "fresh")


@registered("""with last as (select user_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select 'u' || user_id as path, case event_type when 'purchase' then 'old' else 'v' || event_id end as content from (
    select user_id, event_type, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'logout'""")
def replayed_changes(spark, sf_dir):
    """The state of files after a feed of changes: removed ones keep their content until they are confirmed gone."""
    kind = F.when(F.col("event_type") == "purchase", "unlink").when(F.col("event_type") == "logout", "gone").otherwise("change")
    events = load(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), kind.alias("event_type"), F.struct("ts", "event_id").alias("ts"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("content"))
    state = events.select("path", F.lit("old").alias("content")).distinct()
    return feeds.apply_changes(state, events)


@registered("""with e as (select user_id::varchar as repo, epoch_us(ts) // 1000 as ms from events),
n as (select repo, ms, lead(ms) over (partition by repo order by ms) as following from e)
select repo, ms::bigint as indexed_ms, (ms + 43200000)::bigint as expired_ms from n
where coalesce(following > ms + 43200000, ms + 43200000 < (select max(ms) from e))""")
def streamed_expiries(spark, sf_dir):
    """Indexes of a stream of builds that ran out, twelve hours after the last one: timers and what came too late."""
    out, at = scratch_path(spark, "expiries"), scratch_path(spark, "expiries-checkpoint")
    schema = load(spark, sf_dir, "events").schema
    builds = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = leases.index_expiries(builds, 12 * 3600 * 1000, repo="user_id")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(leases.EXPIRY).parquet(out)
