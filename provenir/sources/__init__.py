"""Reading published documents and the pages that list them."""
