"""From a small source tree to the knowledge base, by hand-made files."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.tree import flatten
from lodestone.plans import knowledge as K
from lodestone.sources import code, native
from lodestone.sources import files as S
from tests.helpers import rows

TREE = {
    "pom.xml": "<project/>",
    "shop/pom.xml": "<project/>",
    "shop/src/main/java/com/x/controller/admin/OrderController.java": """package com.x.controller.admin;
@RestController
@RequestMapping("/orders")
public class OrderController {
    @Autowired private OrderService orderService;
    @PostMapping("/create") public Result create(@RequestBody OrderDTO dto) { return orderService.findById(1L); }
    @GetMapping("/me") public OrderDTO me() { return null; }
}
""",
    "shop/src/main/java/com/x/service/OrderService.java": """package com.x.service;
@Service
public class OrderService {
    private final UserClient userClient;
    @Autowired private OrderMapper mapper;
    @Transactional
    public Order findById(Long id) { this.validate(id); return userClient.getUser(id).toOrder("}"); }
    void validate(Long id) { if (id == null) throw new IllegalArgumentException("no { id"); }
}
""",
    "shop/src/main/java/com/x/dto/OrderDTO.java": "package com.x.dto;\npublic class OrderDTO { private Long id; private String orderName; private Integer status; }\n",
    "shop/src/main/java/com/x/UserClient.java": 'package com.x;\n@FeignClient(name = "user-service", path = "/rpc")\npublic interface UserClient { @GetMapping("/u/{id}") User getUser(@PathVariable("id") Long id); }\n',
    "shop/src/main/java/com/x/UserService.java": "package com.x;\npublic class UserService { }\n",
    "shop/src/main/java/com/x/User.java": """package com.x;
@Entity
@Table(name = "users")
public class User {
    @Id private Long id;
    private String name;
    @OneToMany(mappedBy = "user") private List<Order> orders;
}
""",
    "shop/src/main/java/com/x/mapper/UserMapper.java": "package com.x.mapper;\npublic interface UserMapper extends BaseMapper<User> { }\n",
    "shop/src/main/resources/UserMapper.xml": '<mapper><resultMap id="m" type="com.x.User"><id property="id" column="id"/><result property="email" column="email"/><collection property="orders" ofType="com.x.Order"/></resultMap></mapper>',
    "shop/src/main/resources/schema.sql": "CREATE TABLE users (\n  id BIGINT NOT NULL,\n  created_at DATETIME,\n  amount DECIMAL(10, 2) NOT NULL,\n  PRIMARY KEY (id),\n  FOREIGN KEY (team_id) REFERENCES teams(id)\n);\n",
    "shop/src/main/java/com/x/util/DateUtils.java": "package com.x.util;\npublic class DateUtils { }\n",
    "shop/src/main/java/com/x/State.java": "package com.x;\npublic enum State { A, B }\n",
    "shop/openapi.json": '{"data": {"openapi": "3.0.0", "paths": {"/orders/create": {"post": {"summary": "Create it", "tags": ["o"]}}, "/internal/health": {"get": {}}}}}',
    "web/src/App.vue": '<template><UserCard/><div/></template>\n<script setup>\nimport UserCard from "./UserCard.vue"\n</script>',
    "web/src/UserCard.vue": '<template><p>user</p></template>\n<script>\nimport { fmt } from "./utils"\nexport default { props: ["a"], emits: ["x"] }\n</script>',
    "web/src/utils.ts": "/** Formats things.\n * More. */\nexport function fmt(x: string) { return x }\nexport enum Colour { Red }\n",
    "web/src/api/user.ts": 'export const getUser = (id) => http.get(`/users/${id}`)\n',
    "shop/src/main/java/com/x/config/WebProps.java": 'package com.x.config;\n@ConfigurationProperties(prefix = "shop.web")\npublic class WebProps { private Api adminApi = new Api("/admin-api", "**.controller.**"); }\n',
    "shop/src/main/resources/META-INF/spring.factories": "org.springframework.boot.autoconfigure.EnableAutoConfiguration=\\\n com.x.config.WebProps\n",
    "shop/src/main/proto/stock.proto": "service Stock {\n  rpc Reserve (Req) returns (Resp);\n}\n",
    "svc/router.go": 'package main\ntype Parcel struct {\n\tID int `json:"id"`\n\tWeight float64\n}\nfunc setup(r *gin.Engine) {\n\tv := r.Group("/v1")\n\tv.POST("/parcels", create)\n}\nfunc (p *Packer) Pack(x int) {\n\tbox.Seal(x)\n}\n',
    "svc/box.go": "package main\nfunc Seal(x int) {\n}\n",
    "py/main.py": 'router = APIRouter(prefix="/py")\n\n@router.get("/ping")\nasync def ping():\n    return Report.build(1)\n',
    "py/report.py": "class Report(BaseModel):\n    title: str\n    pages: int = 1\n\n    def build(self):\n        self.check()\n\n    def check(self):\n        pass\n\nclass Helper:\n    x: int\n",
    "web/package.json": '{"name": "@x/web", "dependencies": {"vue": "^3"}}',
    "web/src/router.ts": 'const routes = [{ path: "/admin", children: [{ path: "users", name: "Users" }] }]',
    "web/src/store.ts": 'export const useCart = defineStore("cart", { state: () => ({ items: [] }), actions: { add() {} } })',
    "node_modules/x/pom.xml": "<project/>",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, content in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return root


@pytest.fixture(scope="module")
def files(spark, tree):
    return S.scan(spark, f"file://{tree}").persist()


@pytest.fixture(scope="module")
def modules(files):
    return S.maven_modules(files)


def test_scan_leaves_out_ignored_folders(files):
    assert {r[0] for r in files.select("path").collect()} == {k for k in TREE if "node_modules" not in k}


def test_modules_and_owners(files, modules):
    assert {(r["slug"], r["path"]) for r in modules.collect()} == {("root", ""), ("shop", "shop")}
    some = files.select(F.col("path").alias("file")).where("path LIKE '%OrderService.java' OR path LIKE 'web/src/App.vue'")
    assert {(r["file"].split("/")[-1], r["module_slug"]) for r in K.owned(some, modules).collect()} == {("OrderService.java", "shop"), ("App.vue", "root")}


def test_openapi_wins_over_java(files, modules):
    got = {(r["method"], r["path"]): (r["source"], r["audience"], r["summary"]) for r in K.apis(files, modules).where("source IN ('openapi', 'java')").collect()}
    assert got == {("POST", "/orders/create"): ("openapi", "public", "Create it"), ("GET", "/internal/health"): ("openapi", "internal", "/internal/health"), ("GET", "/orders/me"): ("java", "public", "me")}


def test_rules_put_prefixes_in_front(files, modules):
    got = {r["path"] for r in K.java_endpoints(files, modules, [("**.controller.admin.**", "/never"), ("**.controller.**", "/admin-api")]).collect()}
    assert got == {"/admin-api/orders/create", "/admin-api/orders/me"}


def test_entities_by_precedence(files, modules):
    fields, relations = K.entities(files, modules)
    got = {(r["module_slug"], r["name"]): r["source"] for r in fields.collect()}
    assert got[("", "created_at")] == "sql" and got[("", "amount")] == "sql" and ("", "team_id") not in got
    assert got[("shop", "id")] == "jpa" and got[("shop", "name")] == "jpa" and len([k for k in got if k[0] == "shop"]) == 2 or got.get(("shop", "email")) == "mybatis"
    assert {(r["src"], r["dst"], r["kind"], r["source"]) for r in relations.collect()} == {("User", "Order", "one-to-many", "jpa"), ("users", "teams", "many-to-one", "sql")}


def test_java_calls_and_uses(files):
    nodes, edges = K.call_graph_java(files)
    got = {(r["src"], r["dst"], r["kind"], r["confidence"]) for r in edges.collect()}
    m = "method:"
    assert (f"{m}OrderService#findById", f"{m}OrderService#validate", "calls", "low") in got
    assert (f"{m}OrderService#findById", f"{m}UserClient#getUser", "calls", "high") in got
    assert (f"{m}OrderController#create", f"{m}OrderService#findById", "calls", "high") in got
    assert (f"{m}OrderController#create", "dto:OrderDTO", "uses", "high") in got
    by_id = {r["id"]: r for r in nodes.collect()}
    assert by_id["dto:OrderDTO"]["fields"] == ["id: Long", "orderName: String", "status: Integer"]
    assert by_id[f"{m}OrderService#findById"]["annotations"] == ["@Transactional"] and by_id[f"{m}OrderService#validate"]["annotations"] == []


def test_frontend_imports_and_templates(files):
    _, edges = K.call_graph_frontend(files)
    got = {(r["src"].split("/")[-1], r["dst"].split("/")[-1], r["kind"]) for r in edges.collect()}
    assert got == {("App.vue", "UserCard.vue", "imports"), ("App.vue", "UserCard.vue", "template"), ("UserCard.vue", "utils.ts", "imports")}


def test_flow_reaches_rpcs(spark, files, modules):
    fields, _ = K.entities(files, modules)
    rpcs = S.extract(files, code.java_rpcs, "file string, client string, interface string, method string, http string, path string, pos int", ["@FeignClient"])
    nodes, edges = K.flow_graph(files, fields, rpcs)
    got = {(r["src"], r["dst"]): r["confidence"] for r in edges.collect()}
    assert got[("service:OrderService", "rpc:UserClient")] == "high" and got[("rpc:UserClient", "service:UserService")] == "high"
    assert got[("entity:User", "repository:UserMapper")] == "high"
    assert "rpc" in {r["layer"] for r in nodes.collect()}


def test_java_kinds_in_order(files):
    got = {r["name"]: r["kind"] for r in native.java_kinds(files).collect()}
    assert got == {"DateUtils": "util", "State": "enum", "UserClient": "rpc", "OrderDTO": "pojo"}


def test_frontend_functions(files):
    docs = {r["file"]: r for r in native.ts_docs(files).collect()}
    assert docs["web/src/utils.ts"]["description"] == "Formats things." and docs["web/src/utils.ts"]["signatures"] == ["export function fmt(x: string)", "export enum Colour"]
    assert {(r["kind"], r["name"]) for r in native.ts_exports(files).collect() if "utils" in r["file"]} == {("util", "fmt"), ("enum", "Colour")}
    assert [(r["method"], r["path"]) for r in native.api_clients(files).collect()] == [("GET", "/users/{id}")]


def test_routes_flatten(spark):
    source = 'const routes = [{ path: "/admin", children: [{ path: "settings" }, { path: "users" }] }, { path: "/a", children: [{ path: "b", children: [{ path: "c" }] }] }]'
    tree = spark.createDataFrame([(r[1], r[2], r[3]) for r in code.routes("r.ts", source)], "id string, parent string, path string")
    assert {r["path"] for r in flatten(tree).collect()} == {"/admin", "/admin/settings", "/admin/users", "/a", "/a/b", "/a/b/c"}


def test_go_and_python(spark):
    data = [("svc/r.go", 'r := gin.Default()\nr.GET("/ping", p)\nv := r.Group("/v1")\nv.POST("/u", h)\n'), ("py/m.py", 'router = APIRouter(prefix="/p")\n@router.get("/x")\nasync def fx():\n    pass\n')]
    df = spark.createDataFrame(data, "path string, content string")
    assert [(r["id"], r["method"], r["path"]) for r in K.go_endpoints(df).orderBy("pos").collect()] == [("go-api-svc-0", "GET", "/ping"), ("go-api-svc-1", "POST", "/v1/u")]
    assert rows(K.python_endpoints(df).select("method", "path", "handler")) == [("GET", "/p/x", "fx")]
    assert code.python_methods("p", "class A:\n    def f(self):\n        self.g()\n") == [("p", "A", "f", "self", "g", 1000)]
    assert {(r[1], r[2]) for r in code.python_classes("p", "class A(BaseModel):\n    x: int = 1\nclass B(M):\n    t = models.CharField(3)\n")} == {("A", "BaseModel"), ("B", "M")}


def test_stores_and_contracts():
    s = 'export const useUser = defineStore("user", { state: () => ({ name: "", age: 0 }), getters: { full: (s) => s.name }, actions: { async load() {} } })'
    assert code.stores("s", s)[0][1:6] == ("useUser", "user", ["name", "age"], ["full"], ["load"])
    s = 'const useC = defineStore("c", () => { const n = ref(0); const d = computed(() => n.value); function inc() {} return { n } })'
    assert code.stores("s", s)[0][1:6] == ("useC", "c", ["n"], ["d"], ["inc"])
    assert code.vue_contract("v", 'defineProps<{ title: string; size?: number }>(); defineEmits<{ (e: "save"): void }>()')[0][1:] == (["title", "size"], ["save"])


def test_proto_yml_tables_logs(spark):
    data = [
        ("a.proto", "// c\nservice S {\n  rpc Get (Req) returns (Resp);\n  rpc All (stream a.Req) returns (stream Resp) {}\n}"),
        ("application.yml", "server:\n  port: 80\n  path: /a\n"), ("application-dev.yml", "server:\n  port: 81 # dev\n"),
        ("t.md", "| a | b |\n|---|---|\n| 1 | x \n| 2 | y |\n"), ("x.log", "done\nERROR one\nERROR two\n"),
    ]
    df = spark.createDataFrame(data, "path string, content string")
    assert rows(native.proto(df).select("service", "method", "request", "response")) == [("S", "All", "a.Req", "Resp"), ("S", "Get", "Req", "Resp")]
    assert rows(native.yml_merged(native.yml(df))) == [("server.path", "/a"), ("server.port", "80")]
    assert rows(native.pipe_table(df, 2).select("cells")) == [(["2", "y"],)]
    got = native.log_status(df.where("path = 'x.log'"), ["ERROR", "done"], r"ERROR \w+").first()
    assert (got["ERROR"], got["done"], got["last_match"]) == (2, 1, "ERROR two")


def test_one_bad_file_costs_only_itself(spark):
    def parse(path, content):
        if content == "bad":
            raise ValueError("odd")
        return [(path, 1)]

    df = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", None)], "path string, content string")
    assert rows(S.extract(df, parse, "file string, n int")) == [("a", 1)]
    assert rows(S.extract(df, parse, "file string, n int", errors=True)) == [("b", "ValueError: odd")]


def test_packages_by_globs(spark):
    def of(*files):
        return rows(S.packages(spark.createDataFrame(list(files), "path string, content string")))

    pkg = lambda name, dep="vue": f'{{"name": "{name}", "devDependencies": {{"{dep}": "1"}}}}'
    inner = [("packages/a/package.json", pkg("@s/a")), ("packages/b/package.json", pkg("b", "react")), ("packages/b/deep/package.json", pkg("deep")), ("apps/x/package.json", pkg("x", "lodash"))]
    assert of(("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - \"!packages/b\"\n"), ("package.json", '{"name": "root", "workspaces": ["apps/*"]}'), *inner) == [("a", "@s/a", "packages/a", "vue")]
    assert of(("package.json", '{"name": "root", "workspaces": {"packages": ["apps/*", "packages/**"]}}'), *inner) == [("a", "@s/a", "packages/a", "vue"), ("b", "b", "packages/b", "react"), ("deep", "deep", "packages/b/deep", "vue"), ("x", "x", "apps/x", None)]
    assert of(("package.json", '{"name": "root"}'), *inner) == [("root", "root", "", None)]
    assert of(("one/package.json", pkg("one")), ("two/package.json", pkg("two", "lodash")), *inner) == [("one", "one", "one", "vue")]


def test_a_live_source_is_a_table_of_files(spark):
    def fetch(url):
        if "down" in url:
            raise OSError
        return "{}"

    assert rows(S.http_files(spark, ["https://a.test/1", "https://down.test"], fetch)) == [("https://a.test/1", "{}"), ("https://down.test", None)]


def test_start_init_then_sync(spark, tree, tmp_path):
    import shutil

    root, out = tmp_path / "repo", f"file://{tmp_path}/kb"
    shutil.copytree(tree, root)
    store = K.start_init(spark, f"file://{root}", out)
    ids = [r["id"] for r in store.read("chunks").orderBy("id").collect()]
    assert len(ids) == len(set(ids)) and ids
    nodes = {r["path"]: r for r in store.read("index").collect()}
    assert nodes["backend"]["kind"] == "scope" and "backend/shop" in nodes["backend"]["children"] and nodes["backend/shop/util"]["chunks"]
    docs = {r["path"]: r["markdown"] for r in K.documents(store).collect()}
    assert "| POST | /orders/create | Create it | openapi |" in docs["backend/shop/api.md"]
    assert not K.sync(spark, f"file://{root}", store, dry_run=True).count()
    base = root / "shop/src/main/java/com/x"
    (base / "util/DateUtils.java").unlink()
    (base / "State.java").write_text("package com.x;\npublic enum State { A, B, C }\npublic enum Other { D }\n")
    (base / "util/NewUtils.java").write_text("public class NewUtils { }")
    want = {("DateUtils.java", "deleted"), ("State.java", "modified"), ("NewUtils.java", "unregistered")}
    dry = {(r["path"].split("/")[-1], r["bucket"]) for r in K.sync(spark, f"file://{root}", store, dry_run=True).collect()}
    assert dry == want and not rows(K.audit(spark, f"file://{root}", store, paths=["nothing"])) and "DateUtils" in {r["name"] for r in store.read("cards").collect()}
    K.sync(spark, f"file://{root}", store)
    names = {r["name"] for r in store.read("cards").collect()}
    assert "DateUtils" not in names and {"NewUtils", "State"} <= names
    assert not K.sync(spark, f"file://{root}", store, dry_run=True).count()


def test_a_file_saved_after_the_listing_stays_as_it_was_listed(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("a = 1\n")
    root = f"file://{tmp_path}/src"
    S.scan(spark, root).write.parquet(f"{tmp_path}/before")
    now = S.rescan(spark, root, spark.read.parquet(f"{tmp_path}/before"))
    (tmp_path / "src/a.py").write_text("a = 1000\n")
    assert rows(now.select("path", "content")) == [("a.py", "a = 1\n")]  # and not gone


def test_a_scan_of_small_files_is_few_tasks(spark, tree, tmp_path):
    files = S.scan(spark, f"file://{tree}")
    assert files.rdd.getNumPartitions() > 1  # by the listing
    store = K.start_init(spark, f"file://{tree}", f"file://{tmp_path}/kb")
    kept = store.read("files")
    assert len(kept.inputFiles()) == 1 and rows(kept.select("path", "content", "size")) == rows(files.select("path", "content", "size"))


def test_calls_of_a_common_name_do_not_meet_every_class(spark):
    n = 60
    text = "class C{0}:\n    def get(self):\n        pass\n\n    def run(self):\n        self.get()\n        other.get()\n        c{1}.get()\n        x.only{1}()\n\n    def only{0}(self):\n        pass\n"
    files = spark.createDataFrame([(f"m{i}.py", text.format(i, (i + 1) % n)) for i in range(n)], "path string, content string")
    edges = K.call_graph_others(files)[1]
    got = edges.select("src", "dst", "confidence").collect()
    want = [(f"method:C{i}#run", f"method:C{j}#{m}", c) for i in range(n) for j, m, c in ((i, "get", "high"), ((i + 1) % n, "get", "high"), ((i + 1) % n, f"only{(i + 1) % n}", "low"))]
    assert sorted(map(tuple, got)) == sorted(want)
    joins = [line for line in edges._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert joins and not any(" OR " in line for line in joins)  # by equality alone: no pair is made to be thrown away


def test_every_language_reaches_the_tables(spark, tree, tmp_path):
    import shutil

    root = tmp_path / "repo"
    shutil.copytree(tree, root)
    store = K.start_init(spark, f"file://{root}", f"file://{tmp_path}/kb")
    api = {(r["source"], r["method"], r["path"]) for r in store.read("apis").collect()}
    assert api >= {("go", "POST", "/v1/parcels"), ("python", "GET", "/py/ping"), ("java", "GET", "/admin-api/orders/me"), ("openapi", "POST", "/orders/create")}
    fields = {(r["entity"], r["name"], r["source"]) for r in store.read("entity_fields").collect()}
    assert fields >= {("Parcel", "Weight", "go"), ("Report", "pages", "python")} and not any(e == "Helper" for e, *_ in fields)
    calls = {(r["src"], r["dst"]) for r in store.read("call_edges").collect()}
    assert calls >= {("method:Packer#Pack", "method:box#Seal"), ("method:Report#build", "method:Report#check"), ("method:main#ping", "method:Report#build"), ("method:OrderController#create", "method:OrderService#findById")}
    assert ("Stock", "/Stock/Reserve") in {(r["interface"], r["path"]) for r in store.read("rpcs").collect()}
    assert {r["full_path"] for r in store.read("routes").collect()} == {"/admin", "/admin/users"}
    assert [(r["store_id"], r["state"], r["actions"]) for r in store.read("stores").collect()] == [("cart", ["items"], ["add"])]
    assert {r["file"].split("/")[-1]: (r["props"], r["emits"]) for r in store.read("vue_contracts").collect()}["UserCard.vue"] == (["a"], ["x"])
    assert rows(store.read("packages")) == [("web", "@x/web", "web", "vue")] and rows(store.read("starters")) == [("shop", ["com.x.config.WebProps"])]
    assert rows(store.read("path_rules").select("prefix", "confidence")) == [("/admin-api", "high")] and not rows(store.read("errors"))
    # a sync brings graphs up to date, not only cards
    base = root / "shop/src/main/java/com/x"
    (base / "Coupon.java").write_text("package com.x;\n@Entity\npublic class Coupon { @Id private Long id; }\n")
    (base / "mapper/CouponMapper.java").write_text("package com.x.mapper;\npublic interface CouponMapper extends BaseMapper<Coupon> { }\n")
    (base / "mapper/UserMapper.java").unlink()
    K.sync(spark, f"file://{root}", store)
    from lodestone.plans.api import Engine

    engine = Engine(store)
    assert {r["name"] for r in engine.query_impact("Coupon")["neighbours"].collect()} >= {"CouponMapper"}
    assert "UserMapper" not in {r["name"] for r in engine.query_impact("User")["neighbours"].collect()}
    assert {r["unit"] for r in store.read("affected_units").collect()} >= {"/shop"}
