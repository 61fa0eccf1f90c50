"""Jobs on tables of recognised text: flat and nested spatial operators, classification, and typed extraction."""
