from sparkpoison.sources.tables import export_labelled, for_tenant, load_table, write_audit, write_results

__all__ = ["export_labelled", "for_tenant", "load_table", "write_audit", "write_results"]
