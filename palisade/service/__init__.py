"""The request pipeline around secured queries."""
