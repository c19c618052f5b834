"""Skill vocabulary.

Fixed values: the labels, groups and word lists below decide which mentions
are found, so they are stated literally and in their significant order.
"""

from __future__ import annotations

# Known labels, in search order.
KNOWN_LABELS = [
    "React", "TypeScript", "JavaScript", "CSS", "HTML", "SQL", "Python", "Excel",
    "Docker", "Figma", "User research", "Prototyping", "Product strategy",
    "Patient care", "Nursing", "Care planning", "Java", "AWS", "Git", "Node.js",
    "Project management", "Leadership", "Customer service",
    "Data analysis", "C++", "C#", "Go", "Rust", "Kubernetes", "PostgreSQL",
    "FastAPI", "Django", "Flask", "Linux", "Azure", "GCP", "Terraform", "Redis",
    "GraphQL", "MongoDB", "Spark", "Pandas", "NumPy", "Tableau", "Power BI",
    "Salesforce", "SAP", "Jira", "Agile", "Scrum", "CI/CD", "Machine learning",
    "Ansible", "Jenkins", "Grafana", "Prometheus", "Bash", "PowerShell",
    "GitHub Actions", "GitLab CI/CD", "Jenkins Pipelines", "K8s", "EKS",
    "Continuous Integration", "Continuous Delivery",
]

# Posting phrases that are never technical skills.
GENERIC_TERMS = [
    "communication", "communications", "communication skills", "written communication",
    "verbal communication", "excellent communication", "teamwork", "team player",
    "collaboration", "collaborative", "interpersonal", "interpersonal skills",
    "problem solving", "problem-solving", "attention to detail", "time management",
    "self-motivated", "self motivated", "fast learner", "quick learner", "work ethic",
    "positive attitude", "multitasking", "multi-tasking", "organizational skills",
    "organisation skills",
]

# Spellings of one tool; the first spelling is the canonical name.
ALIAS_GROUPS = [
    ["CI/CD", "CICD", "CI-CD", "CI CD", "Continuous Integration", "Continuous Delivery", "Continuous Deployment"],
    ["Kubernetes", "K8s"],
    ["Jenkins", "Jenkins Pipelines", "Jenkins Pipeline", "Jenkins CI"],
    ["GitHub Actions", "Github Actions", "GH Actions"],
    ["GitLab CI/CD", "GitLab CI", "Gitlab CI/CD", "Gitlab CI"],
    ["PostgreSQL", "Postgres"],
    ["Node.js", "NodeJS"],
    ["RHEL", "Red Hat", "Red Hat Enterprise Linux", "Redhat"],
    ["REST APIs", "REST API", "RESTful APIs", "RESTful"],
    ["AWS", "Amazon Web Services"],
    ["Azure", "Microsoft Azure"],
    ["GCP", "Google Cloud", "Google Cloud Platform"],
    ["Agile", "Agile (Scrum)", "Agile Scrum"],
]

# Fixed values: (umbrella labels, tool labels) per family. A tool on a profile
# covers the umbrella on a posting, never a sibling tool.
FAMILIES = [
    (["CI/CD"], ["Jenkins", "GitHub Actions", "GitLab CI/CD", "CircleCI", "Bitbucket Pipelines",
                 "Azure DevOps", "Azure Pipelines", "Travis CI"]),
    (["Linux"], ["RHEL", "Ubuntu", "Debian", "CentOS", "Fedora"]),
    (["Git", "Version Control"], ["GitHub", "GitLab", "Bitbucket"]),
    (["Containers", "Containerization"], ["Docker"]),
    (["Monitoring", "Observability", "Metrics", "Alerting"], ["Prometheus", "Grafana"]),
    (["Logging"], ["Splunk", "ELK", "ELK Stack"]),
    (["Access Control", "IAM", "Identity and Access Management"], ["LDAP", "Okta", "CyberArk", "SSO"]),
    (["SQL"], ["PostgreSQL", "MySQL", "SQL Server", "SQLite", "MariaDB"]),
]

# People topics of a posting and the terms (English, Dutch) that show them.
SOFT_TOPICS = {
    "Communication": ["communication", "communicate", "explain", "explained", "presenting", "presentation",
                      "stakeholder", "stakeholders", "communicatief", "communicatie"],
    "Collaboration": ["collaboration", "collaborate", "collaborated", "cross-functional", "teamwork",
                      "samenwerken", "samenwerking"],
    "Leadership": ["leadership", "mentoring", "mentor", "mentored", "coaching", "coach", "coached",
                   "leiderschap", "begeleiden"],
    "Problem solving": ["problem solving", "problem-solving", "troubleshoot", "root cause", "analytical",
                        "analytisch"],
    "Prioritization": ["prioritization", "prioritisation", "prioritize", "prioritise", "deadlines",
                       "time management", "prioriteiten"],
    "Conflict resolution": ["conflict", "disagreement", "negotiate", "negotiation", "onderhandelen"],
}
