from docweave.plans import catalog_plans, graph_plans, more_plans, search_plans, text_plans

MODULES = (text_plans, search_plans, catalog_plans, graph_plans, more_plans)
