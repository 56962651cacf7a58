"""tallyline.functions"""
