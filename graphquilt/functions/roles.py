"""Role and layer of a file from its path: own rules, tests, the longest folder rule, file name rules, ``other``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names by convention, role and layer; the longest match wins, the first among equals.
FOLDERS = (
    ("/routers/", "router", "presentation"),
    ("/routes/", "router", "presentation"),
    ("/controllers/", "controller", "presentation"),
    ("/webhooks/", "webhook", "presentation"),
    ("/middleware/", "middleware", "presentation"),
    ("/server/api/", "api_route", "presentation"),
    ("/server/middleware/", "middleware", "presentation"),
    ("/handlers/", "handler", "application"),
    ("/managers/", "manager", "application"),
    ("/services/", "service", "application"),
    ("/usecases/", "usecase", "application"),
    ("/use_cases/", "usecase", "application"),
    ("/interactors/", "interactor", "application"),
    ("/actions/", "action", "application"),
    ("/tasks/", "task", "application"),
    ("/jobs/", "job", "application"),
    ("/workers/", "worker", "application"),
    ("/events/", "event", "application"),
    ("/subscribers/", "subscriber", "application"),
    ("/validators/", "validator", "application"),
    ("/models/", "model", "domain"),
    ("/entities/", "entity", "domain"),
    ("/domain/", "domain_obj", "domain"),
    ("/schemas/", "schema", "domain"),
    ("/dto/", "dto", "domain"),
    ("/types/", "type", "domain"),
    ("/providers/", "provider", "infra"),
    ("/adapters/", "adapter", "infra"),
    ("/repositories/", "repository", "infra"),
    ("/repos/", "repository", "infra"),
    ("/clients/", "client", "infra"),
    ("/integrations/", "integration", "infra"),
    ("/utils/", "util", "infra"),
    ("/lib/", "lib", "infra"),
    ("/helpers/", "util", "infra"),
    ("/templates/", "template", "presentation"),
    ("/migrations/", "migration", "infra"),
    ("/alembic/versions/", "migration", "infra"),
    ("/prisma/migrations/", "migration", "infra"),
    ("/components/", "component", "presentation"),
    ("/pages/", "page", "presentation"),
    ("/views/", "view", "presentation"),
    ("/layouts/", "layout", "presentation"),
    ("/app/", "page", "presentation"),
    ("/composables/", "composable", "application"),
    ("/hooks/", "hook", "application"),
    ("/stores/", "store", "application"),
    ("/store/", "store", "application"),
    ("/contexts/", "context", "application"),
    ("/apps/", "app", "presentation"),
    ("/packages/", "package", "infra"),
    ("/workspaces/", "package", "infra"),
    ("/modules/", "tf_module", "infra"),
    ("/environments/", "tf_env", "infra"),
    ("/envs/", "tf_env", "infra"),
    ("/charts/", "helm_chart", "infra"),
    ("/manifests/", "k8s_manifest", "infra"),
    ("/k8s/", "k8s_manifest", "infra"),
    ("/scripts/", "script", "infra"),
    ("/bin/", "script", "infra"),
    ("/tools/", "script", "infra"),
    ("/docs/", "doc", "doc"),
    ("/documentation/", "doc", "doc"),
    ("/tests/", "test", "test"),
    ("/test/", "test", "test"),
    ("/__tests__/", "test", "test"),
    ("/spec/", "test", "test"),
    ("/e2e/", "test", "test"),
    ("/cypress/", "test", "test"),
)
# File names by convention, tried in order on the last path segment.
FILE_NAMES = (
    (r"(?i)(^|_)handler\.py$", "handler", "application"),
    (r"(?i)(^|_)manager\.py$", "manager", "application"),
    (r"(?i)(^|_)service\.py$", "service", "application"),
    (r"(?i)(^|_)router\.py$", "router", "presentation"),
    (r"(?i)(^|_)adapter\.py$", "provider", "infra"),
    (r"(?i)(^|_)parser\.py$", "parser", "infra"),
    (r"(?i)(^|_)subscriber\.py$", "subscriber", "application"),
    (r"(?i)^conftest\.py$", "test", "test"),
    (r"(?i)^test_.*\.py$", "test", "test"),
    (r"(?i)\.test\.(ts|js|tsx|jsx)$", "test", "test"),
    (r"(?i)\.spec\.(ts|js|tsx|jsx)$", "test", "test"),
    (r"(?i)\.vue$", "component", "presentation"),
    (r"(?i)\.tf$", "tf_resource", "infra"),
    (r"(?i)\.md$", "doc", "doc"),
    (r"(?i)\.mdx$", "doc", "doc"),
    (r"(?i)pyproject\.toml$", "manifest", "infra"),
    (r"(?i)package\.json$", "manifest", "infra"),
    (r"(?i)Dockerfile$", "container", "infra"),
    (r"(?i)docker-compose\.ya?ml$", "container", "infra"),
)
# Folders and names of tests, whatever else is in the path.
TEST_PATH = r"(^|/)(tests|test|__tests__|spec|e2e|cypress)/|(^|/)(conftest\.py|test_[^/]*\.py)$|(_test\.py|_test\.go|_spec\.rb|_test\.rb|Test\.java|Tests\.java|Test\.kt|Tests\.cs|Test\.cs)$|\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs|mts|cts)$"

LAYERS = ("presentation", "application", "domain", "infra", "test", "doc", "other")


def is_test(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.coalesce(p.rlike(TEST_PATH), F.lit(False))


def classify(path: Column | str, own: list[tuple[str, str, str]] | None = None) -> Column:
    """``struct<role, layer>`` of a path; ``own`` are (fragment, role, layer) rules that come first."""
    p = F.col(path) if isinstance(path, str) else path
    low = F.lower(F.concat(F.lit("/"), F.regexp_replace(p, r"^/+", "")))
    name = F.regexp_extract(p, r"([^/]*)$", 1)

    def said(role: str, layer: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(layer).alias("layer"))

    out: Column | None = None
    for fragment, role, layer in own or []:
        test = F.contains(low, F.lit(fragment.lower()))
        out = F.when(test, said(role, layer)) if out is None else out.when(test, said(role, layer))
    out = F.when(is_test(p), said("test", "test")) if out is None else out.when(is_test(p), said("test", "test"))
    for fragment, role, layer in sorted(FOLDERS, key=lambda r: -len(r[0])):
        out = out.when(F.contains(low, F.lit(fragment)), said(role, layer))
    for rx, role, layer in FILE_NAMES:
        out = out.when(name.rlike(rx), said(role, layer))
    return out.otherwise(said("other", "other"))
