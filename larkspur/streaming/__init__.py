"""Changes as streams, and queries over them."""
