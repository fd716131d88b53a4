"""Rule catalogue: the fixed values the results are made of."""

from __future__ import annotations

from typing import NamedTuple

# ---------------------------------------------------------------------------
# Regression-risk rules (texts and grades must be exactly these).
# ---------------------------------------------------------------------------


class RiskRule(NamedTuple):
    rule_id: str
    stage: int
    type: str
    severity: str
    description: str
    mitigation: str
    tests: list[str]


RISK_RULES = [
    RiskRule("R01", 1, "api_change", "critical", "API endpoint removed: {}",
             "Add deprecation notice and migration path",
             ["Test all client applications", "Verify API backward compatibility",
              "Check API documentation updates"]),
    RiskRule("R02", 1, "api_change", "high", "API endpoint modified in {}",
             "Ensure backward compatibility or version the API",
             ["Test with existing API clients", "Verify request/response format compatibility",
              "Update API tests"]),
    RiskRule("R03", 3, "api_change", "high", "Function parameters changed: {}",
             "Update all callers or maintain backward compatibility",
             ["Test all calls to {}", "Verify parameter validation", "Check default parameter values"]),
    RiskRule("R04", 4, "behavior_change", "high", "Control flow logic modified",
             "Ensure all edge cases are covered",
             ["Test all conditional branches", "Verify edge cases", "Check boundary conditions"]),
    RiskRule("R05", 5, "behavior_change", "high", "Return values modified",
             "Verify all callers handle new return values",
             ["Test return value compatibility", "Check error handling", "Verify type consistency"]),
    RiskRule("R06", 6, "behavior_change", "medium", "Exception handling modified",
             "Ensure error handling remains robust",
             ["Test error scenarios", "Verify exception propagation", "Check error messages"]),
    RiskRule("R07", 7, "performance", "medium", "Additional loops added, potential performance impact",
             "Profile code and optimize if necessary",
             ["Run performance benchmarks", "Test with large datasets", "Monitor resource usage"]),
    RiskRule("R08", 8, "performance", "high", "Additional database queries detected",
             "Consider query optimization or caching",
             ["Profile database queries", "Check for N+1 query problems", "Test query performance"]),
    RiskRule("R09", 9, "performance", "high", "Synchronous I/O in async function",
             "Use async I/O libraries",
             ["Test async performance", "Check for blocking operations", "Monitor event loop"]),
    RiskRule("R10", 10, "security", "critical", "Potential SQL injection vulnerability",
             "Use parameterized queries",
             ["Test with malicious input", "Run security scanning tools", "Review query construction"]),
    RiskRule("R10b", 10, "security", "critical", "Potential SQL injection vulnerability",
             "Use parameterized queries",
             ["Test with malicious input", "Run security scanning tools", "Review query construction"]),
    RiskRule("R11", 11, "security", "critical", "Authentication/authorization checks removed",
             "Ensure proper access controls remain in place",
             ["Test unauthorized access attempts", "Verify permission checks", "Audit access logs"]),
    RiskRule("R12", 12, "security", "critical", "Hardcoded secrets detected",
             "Use environment variables or secret management service",
             ["Scan for exposed secrets", "Verify secret rotation", "Check environment configuration"]),
    RiskRule("R13", 13, "behavior_change", "low", "New dependencies introduced",
             "Verify dependency compatibility and security",
             ["Check dependency versions", "Run security audit", "Test in isolated environment"]),
    RiskRule("R14", 14, "api_change", "medium", "File renamed: {}",
             "Update all imports and references",
             ["Verify all imports are updated", "Check configuration files", "Test module loading"]),
    RiskRule("R15", 15, "behavior_change", "high", "Multiple interfaces modified simultaneously",
             "Ensure all implementations are updated consistently",
             ["Run integration tests", "Verify interface contracts", "Check for version mismatches"]),
    RiskRule("R16", 16, "behavior_change", "medium", "Large number of files changed",
             "Consider breaking into smaller, incremental changes",
             ["Run comprehensive test suite", "Perform staged rollout", "Monitor system behavior closely"]),
]
RISK_BY_ID = {rule.rule_id: rule for rule in RISK_RULES}

SEVERITY_SCORES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RISK_TYPE_SCORES = {"security": 4, "api_change": 3, "behavior_change": 2, "performance": 1}

# Route declarations in diffs, in the order they are tried.
DIFF_ROUTE_PATTERNS = [
    r"""@app\.route\s*\(['"]([^'"]+)['"]\)""",
    r"""@(app|router)\.(get|post|put|delete|patch)\s*\(['"]([^'"]+)['"]\)""",
    r"""path\s*\(['"]([^'"]+)['"]""",
    r"""(app|router)\.(get|post|put|delete|patch)\s*\(['"]([^'"]+)['"]""",
]
CONDITION_WORDS = ["if ", "elif ", "while ", "for "]
RETURN_WORDS = ["return "]
EXCEPTION_WORDS = ["except ", "raise ", "try:"]
LOOP_WORDS = ["for ", "while "]
QUERY_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", ".query(", ".filter(", ".all()", ".first()"]
BLOCKING_WORDS = ["open(", "requests.", "urllib."]
AUTH_WORDS = ["@login_required", "@requires_auth", "check_permission", "authenticate"]
DEPENDENCY_WORDS = ["import", "require"]
INTERFACE_WORDS = ["class ", "interface ", "trait "]
SQL_BUILDING_PATTERNS = [
    r"\.format\s*\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)",
    r"%\s*\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE)",
    r"\+.*(?:SELECT|INSERT|UPDATE|DELETE)",
]
# Own extension: an f-string holding a statement and a placeholder.
SQL_FSTRING_PATTERN = r"""\bf["'].*(?:SELECT|INSERT|UPDATE|DELETE).*\{"""
SECRET_PATTERNS = [
    r"""(?:password|secret|key|token)\s*=\s*["'][^"']+["']""",
    r"""(?:AWS|AZURE|GCP)_[A-Z_]+\s*=\s*["'][^"']+["']""",
]
LARGE_CHANGE_SET = 10

# ---------------------------------------------------------------------------
# Facts read from source text.
# ---------------------------------------------------------------------------

LIBRARY_CALL_PATTERNS = {
    "requests": r"requests\.(get|post|put|delete)\s*\(",
    "boto3": r"boto3\.client\s*\(",
    "redis": r"redis\.Redis\s*\(",
    "psycopg2": r"psycopg2\.connect\s*\(",
    "pymongo": r"pymongo\.MongoClient\s*\(",
    "kafka": r"kafka\.KafkaProducer\s*\(",
    "celery": r"celery\.Celery\s*\(",
}
ENDPOINT_PATTERNS = {
    "flask": r"""@app\.(route|get|post|put|delete)\s*\(['"]([^'"]+)['"]\)""",
    "fastapi": r"""@router\.(get|post|put|delete)\s*\(['"]([^'"]+)['"]\)""",
    "flask-restful": r"""@api\.(route|resource)\s*\(['"]([^'"]+)['"]\)""",
}
DB_QUERY_PATTERNS = {
    "sql": r"(SELECT|INSERT|UPDATE|DELETE)\s+.*?\s+FROM\s+(\w+)",
    "sqlalchemy": r"db\.session\.(query|add|delete|commit)\s*\(",
    "django-orm": r"\.objects\.(all|filter|get|create|update|delete)\s*\(",
}
# Where services live, relative to the repository root; later ones win.
SERVICE_LAYOUTS = ["services/*", "microservices/*", "apps/*", "src/services/*", "*-service", "*-api", "*-worker"]
SERVICE_CODE_SUFFIXES = [".py", ".js"]

# ---------------------------------------------------------------------------
# Smells, metrics and risk areas.
# ---------------------------------------------------------------------------

GOD_SERVICE_ENDPOINTS = 20
GOD_SERVICE_FIX = "Split into smaller, focused services based on domain boundaries"
HIGH_MEAN_COMPLEXITY = 10
HIGH_COMPLEXITY_FIX = "Refactor complex functions and classes"
SHARED_DATABASE_FIX = "Consider database-per-service pattern or API-based data access"
OVER_COMPLEX_SERVICE = 100
API_DEPENDENCY_STRENGTH = 0.7
DATABASE_ADVICE = "Consider implementing database-per-service pattern for better isolation"
HIGH_CENTRALITY = 0.5
SINGLE_POINT_SHARE = 0.5

# ---------------------------------------------------------------------------
# Commit metadata.
# ---------------------------------------------------------------------------

COMMIT_TYPE_WORDS = {
    "feat": ["add", "implement", "create", "introduce"],
    "fix": ["fix", "resolve", "correct", "repair"],
    "refactor": ["refactor", "restructure", "reorganize", "optimize"],
    "test": ["test", "testing", "coverage", "spec"],
    "docs": ["document", "documentation", "readme", "comment"],
    "style": ["format", "style", "lint", "prettier"],
    "perf": ["performance", "optimize", "speed", "efficiency"],
    "chore": ["update", "upgrade", "configure", "setup"],
    "build": ["build", "compile", "bundle", "package"],
    "ci": ["ci", "pipeline", "workflow", "automation"],
}
COMMIT_TYPE_BY_STEP = {
    "extract_service": "refactor",
    "merge_services": "refactor",
    "split_service": "refactor",
    "rename": "refactor",
    "restructure": "refactor",
    "dependency_injection": "refactor",
    "interface_extraction": "refactor",
    "database_migration": "feat",
    "api_versioning": "feat",
    "remove_dead_code": "chore",
}
SCOPELESS_DIRECTORIES = [".", "", "src", "lib"]
SCOPE_PATTERN = r"(service|api|worker|gateway)[-_]?(\w+)"
LEADING_VERBS = ["implement", "create", "add", "update", "refactor", "fix"]
HEADER_LIMIT = 72
HEADER_MIN_WORDS = 3
HEADER_PATTERN = r"^(feat|fix|docs|style|refactor|test|chore|perf|ci|build)(\(.+\))?: .+"
COMMIT_LINE_LIMIT = 1000
BREAKING_NOTICE = "BREAKING CHANGE: API modifications may affect existing clients"

STEP_TYPES = list(COMMIT_TYPE_BY_STEP)
SAFETY_LEVELS = ["low", "medium", "high"]
SEVERITIES = ["critical", "high", "medium", "low"]

# ---------------------------------------------------------------------------
# Backlog steps.
# ---------------------------------------------------------------------------


class StepTemplate(NamedTuple):
    """A backlog step; ``{}`` stands for the subject (a service, or a pair)."""

    id: str
    type: str
    description: str
    effort: int
    risk_level: str
    commit_message: str
    validation_steps: list[str]
    target_files: list[str] = []
    dependencies: list[str] = []


STEP_TEMPLATES = {
    "extract_context": StepTemplate(
        "extract-context-{}", "split_service", "Extract bounded contexts from {}", 16, "medium",
        "refactor: extract bounded contexts from {}",
        ["Verify all endpoints still function", "Check data consistency", "Validate domain boundaries"]),
    "aggregates": StepTemplate(
        "implement-aggregates", "restructure", "Implement DDD aggregates and entities", 24, "low",
        "refactor: implement DDD aggregates and entities",
        ["Verify aggregate boundaries", "Check invariant enforcement", "Validate entity relationships"],
        dependencies=["extract-context-*"]),
    "domain_events": StepTemplate(
        "create-domain-events", "restructure", "Implement domain events for cross-aggregate communication", 16,
        "medium", "feat: add domain events for aggregate communication",
        ["Verify event publishing", "Check event handling", "Validate event sourcing if applicable"],
        dependencies=["implement-aggregates"]),
    "repositories": StepTemplate(
        "implement-repositories", "interface_extraction", "Create repository interfaces and implementations", 12,
        "low", "refactor: implement repository pattern for data access",
        ["Verify data access patterns", "Check repository contracts", "Validate persistence logic"],
        dependencies=["implement-aggregates"]),
    "broker": StepTemplate(
        "setup-message-broker", "restructure", "Set up message broker infrastructure (Kafka/RabbitMQ)", 8, "low",
        "feat: add message broker infrastructure",
        ["Verify broker connectivity", "Check topic/queue creation", "Validate message persistence"],
        target_files=["docker-compose.yml", "infrastructure/"]),
    "async_call": StepTemplate(
        "async-{source}-{target}", "restructure", "Convert sync call from {source} to {target} to async events", 8,
        "medium", "refactor: convert {source}->{target} to async events",
        ["Verify event publishing", "Check event consumption", "Validate data consistency", "Test failure scenarios"],
        dependencies=["setup-message-broker"]),
    "event_sourcing": StepTemplate(
        "implement-event-sourcing", "database_migration", "Implement event sourcing for critical aggregates", 40,
        "high", "feat: implement event sourcing for audit and replay",
        ["Verify event store", "Check event replay", "Validate projections", "Test snapshot functionality"],
        dependencies=["async-*"]),
    "separate_db": StepTemplate(
        "separate-db-{}", "database_migration", "Separate databases for services: {}", 24, "high",
        "refactor: implement database-per-service for {}",
        ["Verify data migration", "Check data consistency", "Validate cross-service queries",
         "Test rollback procedures"]),
    "api_versioning": StepTemplate(
        "api-versioning-{}", "api_versioning", "Add API versioning to {}", 8, "medium",
        "feat: add API versioning to {}",
        ["Verify backward compatibility", "Check version routing", "Validate deprecation headers"]),
    "service_mesh": StepTemplate(
        "setup-service-mesh", "restructure", "Implement service mesh for observability and security", 32, "medium",
        "feat: add service mesh for improved microservices management",
        ["Verify mesh connectivity", "Check mTLS configuration", "Validate traffic policies",
         "Test circuit breakers"],
        target_files=["kubernetes/", "istio/"], dependencies=["api-versioning-*"]),
    "split_god": StepTemplate(
        "split-god-service-{}", "split_service", "Split {} into smaller services", 40, "high",
        "refactor: split {} into focused services",
        ["Verify service boundaries", "Check data consistency", "Validate API contracts", "Test integration points"]),
    "reduce_complexity": StepTemplate(
        "reduce-complexity-{}", "restructure", "Reduce complexity in {}", 16, "low",
        "refactor: reduce complexity in {}",
        ["Verify functionality preserved", "Check test coverage", "Validate performance"]),
    "dead_code": StepTemplate(
        "remove-dead-code", "remove_dead_code", "Remove unused code and dependencies", 8, "low",
        "chore: remove dead code and unused dependencies",
        ["Verify no runtime dependencies", "Check test coverage", "Validate build process"]),
}
CONTEXT_SPLIT_ENDPOINTS = 10
ASYNC_STRENGTH = 0.5
VERSIONING_FILE_WORDS = ["api", "route"]

BASE_CRITERIA = [
    "All existing functionality preserved",
    "No degradation in performance metrics",
    "All tests passing with >80% coverage",
    "No increase in error rates",
]
TARGET_CRITERIA = {
    "domain-driven": [
        "Clear bounded contexts established",
        "Aggregates enforce business invariants",
        "Domain events enable loose coupling",
    ],
    "event-driven": [
        "All synchronous dependencies converted to events",
        "Message delivery guarantees implemented",
        "Event replay capability verified",
    ],
    "microservices": [
        "Each service has its own database",
        "API versioning implemented",
        "Service discovery and load balancing functional",
    ],
}
COUPLING_LIMIT = 0.3
MITIGATION_STRATEGIES = [
    "Implement comprehensive testing before high-risk changes",
    "Use feature flags for gradual rollout",
    "Maintain rollback procedures for each step",
    "Monitor system metrics during migration",
]
STEP_RISK_SCORES = {"high": 3, "medium": 2}
