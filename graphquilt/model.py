"""The property graph as a catalogue of tables: labels, edge types, keys and columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


@dataclass(frozen=True)
class NodeType:
    """A label: its table, key and whether rows belong to a file."""

    label: str
    table: str
    key: str
    schema: T.StructType

    @property
    def of_file(self) -> bool:
        return "file_path" in self.schema.names


@dataclass(frozen=True)
class EdgeType:
    """A directed edge type between two labels; ``identity`` are the columns that make an edge."""

    name: str
    table: str
    src: str
    dst: str
    src_col: str = "from_id"
    dst_col: str = "to_id"
    props: tuple[str, ...] = ()
    identity_props: tuple[str, ...] = ()

    @property
    def identity(self) -> list[str]:
        return [self.src_col, self.dst_col, *self.identity_props]

    @property
    def schema(self) -> T.StructType:
        return _struct(**{c: _S for c in (self.src_col, self.dst_col, *self.props)})


_SPAN = {"file_path": _S, "start_line": _L, "end_line": _L}

NODES: dict[str, NodeType] = {
    n.label: n
    for n in (
        NodeType("File", "file", "path", _struct(path=_S, lang=_S, mtime=_D, git_blob_sha=_S, role=_S, layer=_S, module_doc=_S)),
        NodeType("Endpoint", "endpoint", "id", _struct(id=_S, method=_S, path=_S, framework=_S, file_path=_S, start_line=_L, router=_S, is_test=_B)),
        NodeType("Function", "function", "id", _struct(id=_S, name=_S, **_SPAN, docstring=_S)),
        NodeType("Class", "class", "id", _struct(id=_S, name=_S, **_SPAN, docstring=_S)),
        NodeType("TFResource", "tf_resource", "id", _struct(id=_S, name=_S, type=_S, **_SPAN, kind=_S, address=_S, module_dir=_S, source_dir=_S)),
        NodeType("TFVar", "tf_var", "id", _struct(id=_S, name=_S, kind=_S, **_SPAN, address=_S, module_dir=_S)),
        NodeType("MdSection", "md_section", "id", _struct(id=_S, title=_S, level=_L, **_SPAN, body_preview=_S, anchor=_S, kind=_S)),
        NodeType("Package", "package", "id", _struct(id=_S, name=_S, pkg_key=_S, ecosystem=_S, version=_S, file_path=_S, start_line=_L, workspaces=_S, workspace_root=_S)),
        NodeType("McpServer", "mcp_server", "id", _struct(id=_S, name=_S, file_path=_S, start_line=_L, transport=_S, command=_S, url=_S, arg_count=_L, env_keys=_S, header_keys=_S)),
    )
}


def _edge(name: str, src: str, dst: str, src_col: str = "from_id", dst_col: str = "to_id", props: tuple[str, ...] = (), identity: tuple[str, ...] = ()) -> EdgeType:
    return EdgeType(name, f"edge_{name.lower()}", src, dst, src_col, dst_col, props, identity)


EDGES: dict[str, EdgeType] = {
    e.name: e
    for e in (
        _edge("IMPORTS", "File", "File", "from_path", "to_path", ("symbol", "kind"), ("symbol",)),
        _edge("DEFINES_FN", "File", "Function", "file_path", "fn_id"),
        _edge("DEFINES_CLASS", "File", "Class", "file_path", "class_id"),
        _edge("CALLS", "Function", "Function"),
        _edge("INHERITS", "Class", "Class"),
        _edge("HAS_METHOD", "Class", "Function"),
        _edge("TF_DEPENDS", "TFResource", "TFResource"),
        _edge("TF_REFS_VAR", "TFResource", "TFVar"),
        _edge("TF_VAR_DEPENDS", "TFVar", "TFResource"),
        _edge("TF_VAR_REFS", "TFVar", "TFVar"),
        _edge("DEFINES_RESOURCE", "File", "TFResource", "file_path", "resource_id"),
        _edge("DEFINES_TFVAR", "File", "TFVar", "file_path", "var_id"),
        _edge("DEFINES_SECTION", "File", "MdSection", "file_path", "section_id"),
        _edge("CONTAINS_SECTION", "MdSection", "MdSection"),
        _edge("MD_LINKS_TO", "MdSection", "File", "from_id", "to_path", ("label",), ("label",)),
        _edge("MD_REFS_SYMBOL", "MdSection", "Function", props=("context",)),
        _edge("MD_REFS_CLASS", "MdSection", "Class", props=("context",)),
        _edge("DEFINES_ENDPOINT", "File", "Endpoint", "file_path", "endpoint_id"),
        _edge("IMPLEMENTED_BY", "Endpoint", "Function"),
        _edge("DEFINES_PACKAGE", "File", "Package", "file_path", "package_id"),
        _edge("DEPENDS_ON", "Package", "Package", props=("dep_group", "spec"), identity=("dep_group",)),
        _edge("DEFINES_MCP_SERVER", "File", "McpServer", "file_path", "server_id"),
    )
}

#: References kept by name, from which edges are derived again by joins.
SIDE: dict[str, T.StructType] = {
    "call_site": _struct(from_id=_S, file_path=_S, name=_S, to_id=_S, kind=_S, hint=_S, ctx=_S),
    "name_ref": _struct(kind=_S, from_id=_S, file_path=_S, name=_S, extra=_S),
    "file_stamp": _struct(path=_S, mtime=_D),
    "rationale": _struct(file_path=_S, line=_L, tag=_S, text=_S, symbol_id=_S, symbol=_S, symbol_kind=_S, symbol_line=_L, adr=_S),
}


def edges_of(label: str) -> list[EdgeType]:
    """Edge types that touch a label at either end."""
    return [e for e in EDGES.values() if label in (e.src, e.dst)]


@dataclass
class Names:
    """Where each catalogue table lies in a folder of parquet tables with other names."""

    of: dict[str, str] = field(default_factory=lambda: {"file": "file_node", "function": "function_node"})

    def __call__(self, table: str) -> str:
        return self.of.get(table, table)
