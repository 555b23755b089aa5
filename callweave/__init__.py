"""callweave: DataFrame operators for call graphs and the text around them."""
