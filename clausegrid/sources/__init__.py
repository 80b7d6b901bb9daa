"""Reading tables and loading rows into them."""
