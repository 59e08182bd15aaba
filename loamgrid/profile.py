"""What is known about one site: the parameters of URL normalisation and scope."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SiteProfile:
    canonical_host: str
    site_hosts: frozenset[str] = frozenset()
    use_https: bool = True
    trailing_slash: bool = True
    base_path: str = "/"
    extra_hosts: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def offline(cls, base_url: str, extra_hosts: tuple[str, ...] = ()) -> SiteProfile:
        """From a base URL alone: its host with and without ``www.``, and the extra hosts."""
        parts = urlsplit(base_url)
        host = (parts.hostname or "").lower()
        bare = host.removeprefix("www.")
        path = parts.path if parts.path.endswith("/") else parts.path + "/"
        return cls(host, frozenset({bare, "www." + bare, *extra_hosts}), parts.scheme == "https", path.endswith("/"), path, frozenset(extra_hosts))

    def owns(self, host: Column) -> Column:
        return host.isin(*sorted({*self.site_hosts, *self.extra_hosts, self.canonical_host}))

    def canonical(self, host: Column) -> Column:
        """The host an owned host folds to; an extra host is a server of its own."""
        kept = host.isin(*sorted(self.extra_hosts)) if self.extra_hosts else F.lit(False)
        return F.when(kept, host).otherwise(F.lit(self.canonical_host))
