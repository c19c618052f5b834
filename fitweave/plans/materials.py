"""Reference material dimension.

Fixed values: title, link, keywords and standing flag of each entry; ranking depends on the keywords and their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (title, url, keywords, always shown)
MATERIALS = [
    ("Tech Interview Handbook", "https://www.techinterviewhandbook.org/",
     ["coding", "algorithms", "javascript", "typescript", "python", "react", "sql", "software engineer", "frontend", "backend"], False),
    ("Behavioral interview guide", "https://www.techinterviewhandbook.org/behavioral-interview/",
     ["behavioral", "collaboration", "communication", "leadership", "stakeholder"], True),
    ("System Design Primer", "https://github.com/donnemartin/system-design-primer",
     ["system design", "distributed", "microservices", "scalability", "architecture", "backend"], False),
    ("DevOps Exercises", "https://github.com/bregman-arie/devops-exercises",
     ["devops", "sre", "platform", "linux", "ci/cd", "jenkins", "ansible", "docker", "kubernetes", "terraform", "prometheus"], False),
    ("DevOps roadmap", "https://roadmap.sh/devops", ["devops", "platform", "sre", "infrastructure", "ci/cd"], False),
    ("Backend roadmap", "https://roadmap.sh/backend", ["backend", "api", "rest", "microservices", "python", "java", "go"], False),
    ("Kubernetes the Hard Way", "https://github.com/kelseyhightower/kubernetes-the-hard-way",
     ["kubernetes", "k8s", "container orchestration"], False),
    ("GitHub Actions docs", "https://docs.github.com/en/actions/get-started/quickstart",
     ["github actions", "ci/cd", "cicd", "pipeline"], False),
    ("Jenkins Pipeline handbook", "https://www.jenkins.io/doc/book/pipeline/", ["jenkins", "ci/cd", "pipeline"], False),
    ("GitLab CI/CD docs", "https://docs.gitlab.com/ci/", ["gitlab", "gitlab ci", "ci/cd", "pipeline"], False),
    ("OpenTofu docs", "https://opentofu.org/docs/", ["terraform", "opentofu", "infrastructure as code", "iac"], False),
    ("Ansible getting started", "https://docs.ansible.com/ansible/latest/getting_started/index.html",
     ["ansible", "automation", "configuration management"], False),
    ("Docker get started", "https://docs.docker.com/get-started/", ["docker", "containers", "containerization"], False),
    ("Prometheus overview", "https://prometheus.io/docs/introduction/overview/",
     ["prometheus", "metrics", "alerting", "monitoring", "observability"], False),
    ("Grafana getting started", "https://grafana.com/docs/grafana/latest/getting-started/",
     ["grafana", "dashboards", "observability", "monitoring"], False),
    ("Python tutorial", "https://docs.python.org/3/tutorial/", ["python", "flask", "backend"], False),
    ("Select Star SQL", "https://selectstarsql.com/", ["sql", "postgres", "postgresql", "mysql", "data"], False),
    ("OWASP Web Security Testing Guide", "https://owasp.org/www-project-web-security-testing-guide/",
     ["security", "owasp", "ssl", "tls", "ldap", "okta", "cyberark", "access control", "iam"], False),
    ("The Art of Command Line", "https://github.com/jlevy/the-art-of-command-line",
     ["linux", "rhel", "bash", "shell", "command line"], False),
]


def materials(spark: SparkSession) -> DataFrame:
    """(title, url, keywords, always); a constant-size dimension."""
    return spark.createDataFrame(MATERIALS, "title string, url string, keywords array<string>, always boolean")
