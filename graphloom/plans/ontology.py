"""Fixed values of the code property graph: labels, edge types, views, schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node labels and stacks.
LABELS = (
    "Application", "Module", "File", "Class", "Component", "Service", "Controller", "Endpoint", "ApiCall", "Method", "DTO",
    "Entity", "Table", "Repository", "Route", "Template", "Deployment", "Datasource", "Topic", "Scenario", "Dependency",
)
STACKS = ("java", "angular", "infra", "system")
# Edge types an extractor may emit; INVOKES_API and infrastructure types are derived here.
KNOWN_EDGES = (
    "DECLARES", "IMPORTS", "INJECTS", "CALLS", "EXTENDS", "IMPLEMENTS", "RENDERS", "BINDS", "USES_TEMPLATE", "NAVIGATES_TO", "EXPOSES",
    "HANDLED_BY", "MAKES_CALL", "ACCEPTS", "RETURNS", "MAPS_TO", "RELATES_TO", "MANAGES", "READS", "WRITES", "PUBLISHES_TO", "CONSUMES_FROM",
)
DERIVED_EDGES = ("INVOKES_API", "CONNECTS_TO", "USES_DATASOURCE", "HOSTS", "PROVIDED_BY", "COVERS", "DECLARES_DEPENDENCY", "USES_DEPENDENCY", "DEPLOYED_AS")
# Edge types that carry change impact.
IMPACT_TYPES = (
    "CALLS", "INJECTS", "EXPOSES", "HANDLED_BY", "MAKES_CALL", "INVOKES_API", "ACCEPTS", "RETURNS", "MAPS_TO", "RELATES_TO", "READS",
    "WRITES", "MANAGES", "RENDERS", "BINDS", "USES_TEMPLATE", "NAVIGATES_TO", "EXTENDS", "IMPLEMENTS", "DECLARES", "USES_DEPENDENCY",
)
STRUCTURAL_LABELS = ("File", "Application", "Module")
ENTRY_LABELS = ("Endpoint", "Controller", "Route", "Component")
ARCHITECTURE_LABELS = ("Controller", "Service", "Component", "Endpoint", "Entity", "Repository", "ApiCall")
PATH_RANKS = ("Controller", "Service", "Component", "Entity", "Repository", "DTO", "Endpoint", "Route", "Class", "Template", "File")
COMMUNITY_LABELS = ("Controller", "Service", "Component", "Endpoint", "Entity", "Repository", "DTO", "Class", "Route")
COMMUNITY_TYPES = ("CALLS", "INJECTS", "RENDERS", "INVOKES_API", "EXPOSES", "HANDLED_BY", "MANAGES", "READS", "WRITES", "MAPS_TO", "RELATES_TO", "ACCEPTS", "RETURNS")

NODES = (
    "project string, id string, fqn string, name string, label string, labels array<string>, stack string, filePath string, startLine int, endLine int, hash string, "
    "props map<string,string>, arr_props map<string,array<string>>, summary string, tags array<string>, community int"
)
EDGES = "project string, src string, type string, dst string, props map<string,string>"


def process_predicate() -> Column:
    """The process view: topics, scenarios, endpoints and methods that are asynchronous, scheduled or transactional."""
    p = F.col("props")
    flagged = (p["async"] == "true") | p["scheduled"].isNotNull() | (p["transactional"] == "true")
    return F.col("label").isin("Topic", "Scenario", "Endpoint") | ((F.col("label") == "Method") & F.coalesce(flagged, F.lit(False)))


def _labels(*names: str):
    return lambda: F.col("label").isin(*names)


# View presets, each a predicate on nodes and its edge types (None: all).
VIEWS = {
    "logical": (_labels("Controller", "Service", "Component", "Endpoint", "Entity", "DTO", "Repository", "ApiCall", "Route", "Dependency"), None),
    "development": (_labels("Application", "Module", "File"), ("IMPORTS", "DECLARES")),
    "physical": (_labels("Application", "Deployment", "Datasource", "Table", "Topic"), ("DEPLOYED_AS", "CONNECTS_TO", "USES_DATASOURCE", "PROVIDED_BY", "HOSTS", "PUBLISHES_TO", "CONSUMES_FROM")),
    "process": (process_predicate, ("PUBLISHES_TO", "CONSUMES_FROM", "HANDLED_BY", "CALLS")),
    "scenarios": (_labels("Scenario", "Route", "Component", "Endpoint", "Entity", "Table"), ("COVERS", "NAVIGATES_TO", "MAPS_TO")),
    "callgraph": (_labels("Method", "Endpoint", "ApiCall"), ("CALLS", "HANDLED_BY", "MAKES_CALL", "INVOKES_API")),
}
