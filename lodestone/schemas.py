"""Explicit schemas of the knowledge tables; every scan output carries file and pos, so order is never implicit."""

API = "id string, method string, path string, summary string, tags array<string>, audience string, source string, module_slug string, file string, pos int"
RPC = "id string, name string, summary string, module_slug string, source string, file string, pos int"
MODULE = "slug string, name string, path string, repo_slug string"
ENTITY = "name string, table string, module_slug string, file string, source string, pos int, fields array<struct<name:string,type:string,column:string,nullable:boolean>>"
RELATION = "src string, dst string, kind string, field string, source string, file string, pos int"
NODE = "id string, kind string, layer string, name string, file string, module_slug string"
EDGE = "src string, dst string, kind string, confidence string, label string, file string, pos int"
SYMBOL = "kind string, name string, file string, description string, members array<string>, pos int"
CARD = "id string, kind string, name string, module_slug string, description string, exports array<string>, source_path string, scope string"
CHUNK = "id string, path string, anchor string, kind string, title string, text string"
SNAPSHOT = "unit string, path string, sha256 string"
CONTRACT = "name string, description string, ts_file_path string, registered_at timestamp"
TOKEN = "name string, value string, bucket string"
