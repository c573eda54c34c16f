"""Closed vocabularies of the graph model. Fixed values, stated plainly."""

CORE_TYPES = ("repository", "directory", "file", "module", "class", "interface", "function", "method", "variable", "type", "enum", "property", "parameter")
ARCHITECTURE_TYPES = ("api", "service", "database", "table", "queue", "event", "external_service")
REPOSITORY_TYPES = ("config", "document", "document_section", "config_property", "api_spec", "api_endpoint", "column", "container")
NODE_TYPES = CORE_TYPES + ARCHITECTURE_TYPES + REPOSITORY_TYPES

RELATIONSHIPS = (
    "CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "INSTANTIATES", "RETURNS", "ACCEPTS", "DEPENDS_ON",
    "ROUTES_TO", "USES", "READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES", "CONFIGURED_BY", "AUTHENTICATED_BY", "VALIDATES", "DEPENDS_ON_SERVICE",
    "DEFINES", "DOCUMENTS", "LINKS_TO", "IMPLEMENTED_BY",
)
BEHAVIOURAL = (
    "CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "IMPORTS", "INSTANTIATES", "ROUTES_TO", "USES", "READS_FROM", "WRITES_TO",
    "PUBLISHES", "SUBSCRIBES", "DEPENDS_ON", "DEPENDS_ON_SERVICE", "IMPLEMENTED_BY", "DEFINES", "DOCUMENTS",
)
DEPENDENCY = ("DEPENDS_ON", "DEPENDS_ON_SERVICE", "IMPORTS", "USES")
STRUCTURAL = ("CONTAINS", "EXPORTS", "IMPORTS")
#: Sections of a node's detail page by relationship set and allowed direction (in, out, both).
SECTIONS = {
    "callers": (("CALLS",), "in"), "callees": (("CALLS",), "out"), "references": (("REFERENCES",), "in"),
    "dependencies": (DEPENDENCY, "out"), "dependents": (DEPENDENCY, "in"), "implementations": (("IMPLEMENTS", "EXTENDS"), "both"),
    "apis": (("ROUTES_TO",), "both"), "databases": (("READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES"), "both"),
    "documentation": (("DOCUMENTS", "LINKS_TO"), "both"), "contracts": (("DEFINES", "IMPLEMENTED_BY"), "both"), "children": (("CONTAINS",), "out"),
}
GROUPS = {
    "structure": ("CONTAINS", "EXPORTS", "DEFINES"), "dependency": ("IMPORTS", "DEPENDS_ON", "DEPENDS_ON_SERVICE", "USES", "CONFIGURED_BY"),
    "behaviour": ("CALLS", "INSTANTIATES", "ROUTES_TO", "IMPLEMENTED_BY", "AUTHENTICATED_BY", "VALIDATES"),
    "type": ("REFERENCES", "IMPLEMENTS", "EXTENDS", "ACCEPTS", "RETURNS"), "data": ("READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES"),
    "knowledge": ("DOCUMENTS", "LINKS_TO"),
}

CONFIDENCE = {"high": 0.95, "medium": 0.8, "low": 0.5}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
#: Confidence of each kind of observation.
POLICY = {
    "scipSymbol": "high", "astDirect": "high", "declaredInSpec": "high", "sqlLiteral": "high", "parsedStructure": "high", "exactRouteMatch": "high",
    "resolvedLink": "high", "derivedFromContainer": "medium", "interpolatedStatement": "medium", "undeclaredDependency": "medium",
    "uniqueNameMatch": "medium", "ambiguousNameMatch": "low",
}

#: Node type: family, category, importance weight.
TYPES = {
    "class": ("types", "code", 0.6), "interface": ("types", "code", 0.5), "type": ("types", "code", 0.2), "enum": ("types", "code", 0.2),
    "function": ("callables", "code", 0.35), "method": ("callables", "code", 0.25), "variable": ("data", "code", 0.08), "property": ("data", "code", 0.08),
    "parameter": ("data", "code", 0.05), "repository": ("structure", "code", 1.0), "directory": ("structure", "code", 0.35), "file": ("structure", "code", 0.3),
    "module": ("structure", "code", 0.6), "api": ("services", "architecture", 0.85), "service": ("services", "architecture", 1.0),
    "external_service": ("services", "architecture", 0.7), "api_spec": ("services", "architecture", 0.75), "api_endpoint": ("services", "architecture", 0.6),
    "database": ("resources", "architecture", 0.85), "table": ("resources", "architecture", 0.55), "column": ("resources", "architecture", 0.08),
    "queue": ("resources", "architecture", 0.6), "event": ("resources", "architecture", 0.55), "container": ("resources", "architecture", 0.7),
    "document": ("documentation", "knowledge", 0.45), "document_section": ("documentation", "knowledge", 0.12), "config": ("configuration", "knowledge", 0.3),
    "config_property": ("configuration", "knowledge", 0.08),
}
FILE_LIKE = ("file", "document", "config", "api_spec")
TREE_TYPES = ("directory", *FILE_LIKE)
OVERVIEW_TYPES = (
    "class", "interface", "type", "function", "method", "api", "api_endpoint", "api_spec", "service", "external_service",
    "database", "table", "queue", "event", "container", "document",
)

#: Named projections: node types (None: any), relationships (None: any), types shown first.
PROJECTIONS = {
    "everything": (None, None, ()),
    "architecture": (
        ("api", "api_endpoint", "service", "external_service", "database", "table", "queue", "event", "container", "config", "class", "interface"),
        ("ROUTES_TO", "IMPLEMENTED_BY", "CALLS", "USES", "READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES", "DEPENDS_ON_SERVICE", "CONFIGURED_BY", "AUTHENTICATED_BY", "VALIDATES", "IMPLEMENTS", "EXTENDS", "DEFINES"),
        ("api", "api_endpoint", "service", "external_service", "database", "table", "queue", "event", "container"),
    ),
    "calls": (("class", "interface", "function", "method"), ("CALLS",), ("function", "method")),
    "files": (("repository", "directory", "file", "module"), ("CONTAINS", "IMPORTS", "EXPORTS", "DEPENDS_ON"), ("file",)),
    "dependencies": (("service", "module", "external_service", "file", "config"), ("DEPENDS_ON", "DEPENDS_ON_SERVICE", "IMPORTS", "USES", "CONFIGURED_BY"), ("service", "external_service", "module")),
    "dataflow": (
        ("api", "api_endpoint", "service", "class", "method", "database", "table", "queue", "event", "external_service"),
        ("ROUTES_TO", "IMPLEMENTED_BY", "CALLS", "READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES", "USES"),
        ("api", "api_endpoint", "table", "queue", "event"),
    ),
    "documentation": (("document", "document_section", "file", "class", "interface", "function", "method", "service", "api", "api_endpoint", "table"), ("CONTAINS", "DOCUMENTS", "LINKS_TO"), ("document", "document_section")),
    "apis": (("api_spec", "api_endpoint", "api", "class", "method", "function", "service"), ("DEFINES", "IMPLEMENTED_BY", "ROUTES_TO", "CALLS"), ("api_spec", "api_endpoint", "api")),
    "configuration": (("config", "config_property", "container", "service", "module", "file"), ("CONFIGURED_BY", "CONTAINS", "DEFINES", "DEPENDS_ON"), ("config", "container")),
    "data": (("database", "table", "column", "class", "method", "config"), ("CONTAINS", "DEFINES", "READS_FROM", "WRITES_TO", "USES"), ("table", "database")),
    "cross-source": (None, ("DOCUMENTS", "LINKS_TO", "DEFINES", "IMPLEMENTED_BY", "CONFIGURED_BY", "ROUTES_TO", "READS_FROM", "WRITES_TO"), ("api_spec", "api_endpoint", "document", "container", "table", "config")),
}
LIMITS = {"depth": (0, 5, 2), "limit": (1, 2000, 500), "search": (1, 100, 20), "path_depth": (1, 12, 6), "neighbours": (1, 1000, 100)}
#: Phases of an indexing run and their share of its progress, in per cent.
PHASES = (("scan", 4), ("index", 45), ("parse", 15), ("build", 22), ("persist", 8), ("finish", 6))


def bounded(name: str, value: int | None) -> int:
    """A checked parameter: its default where None, an error outside its range."""
    low, high, default = LIMITS[name]
    value = default if value is None else value
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def types_of(categories: tuple[str, ...] | None, node_types: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """Explicit types and those of the categories, intersected; None means any, () means none."""
    if categories is None:
        return node_types
    own = tuple(t for t, (_, c, _) in TYPES.items() if c in categories)
    return own if node_types is None else tuple(t for t in own if t in node_types)
