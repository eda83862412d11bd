"""Feature-group algebra: named column lists and how they combine."""

from .constants import DOMAIN_FEATURES, DOMAIN_GROUPS, LEXICAL_FEATURES, LEXICAL_GROUPS


def minus(columns, dropped):
    """`columns` in their order, without those in `dropped`."""
    dropped = set(dropped)
    return [c for c in columns if c not in dropped]


def lexical_group(name):
    if name == "all":
        return list(LEXICAL_FEATURES)
    if name == "all_minus_redundant":
        return minus(LEXICAL_FEATURES, LEXICAL_GROUPS["redundant"])
    return list(LEXICAL_GROUPS[name])


def domain_group(name):
    return list(DOMAIN_FEATURES) if name == "all" else list(DOMAIN_GROUPS[name])


def combine(lexical, domain):
    """Lexical columns then domain columns.

    Both families define `num_subdomains`; when both are asked for, the domain
    definition (non-empty subdomain labels) is the one that is kept.
    """
    return minus(lexical, domain) + list(domain)
